"""Symbol search: patterns with filters, files, class details, fallbacks for empty results."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming, patterns
from .relations import CLASS_KINDS, FUNCTION_KINDS

SCOPES = ("project_code_only", "include_external_libraries")
#: Rows from which on a result counts as large, entries and hits that a fallback samples.
LARGE, SAMPLE, HITS = 20, 200, 10


def project_only(scope: str) -> bool:
    """The scope of a search as a flag; anything else is an error."""
    if scope not in SCOPES:
        raise ValueError(f"search_scope must be one of {SCOPES}, not {scope!r}")
    return scope == SCOPES[0]


@dataclass(frozen=True)
class Criteria:
    """What a search asks for; unset fields do not restrict."""

    pattern: str = ""
    project_only: bool = True
    file_name: str | None = None
    namespace: str | None = None
    class_name: str | None = None
    signature: str | None = None
    max_results: int | None = field(default=None)

    def safe(self) -> "Criteria":
        return replace(self, pattern=patterns.safe(self.pattern) if patterns.is_pattern(self.pattern) else self.pattern)


def _common(q: Criteria) -> Column:
    ok = F.lit(True)
    if q.project_only:
        ok &= F.coalesce("is_project", F.lit(False))
    if q.file_name:
        ok &= F.col("file").contains(q.file_name)
    return ok & patterns.in_namespace(F.col("namespace"), q.namespace)


def class_filter(q: Criteria) -> Column:
    return F.col("kind").isin(*CLASS_KINDS) & patterns.matches_qualified(F.col("qualified_name"), q.pattern) & _common(q)


def function_filter(q: Criteria) -> Column:
    hit = patterns.matches_qualified(F.col("qualified_name"), q.pattern)
    if q.pattern and patterns.pattern_type(q.pattern) == "regex":
        hit |= patterns.full_regex(F.col("name"), q.pattern)
    ok = F.col("kind").isin(*FUNCTION_KINDS) & hit & _common(q)
    if q.class_name:
        ok &= F.col("parent_class") == q.class_name
    if q.signature:
        ok &= F.lower("signature").contains(q.signature.lower())
    return ok


def _limited(df: DataFrame, q: Criteria) -> DataFrame:
    return df if q.max_results is None else df.orderBy("qualified_name", "usr").limit(q.max_results)


def _narrow(df: DataFrame, q: Criteria) -> DataFrame:
    """Rows whose last name component is that of the pattern, by a plain comparison that reaches the scan; all where that cannot be said."""
    if not q.pattern or patterns.pattern_type(q.pattern) == "regex" or "last_lc" not in df.columns:
        return df
    return df.filter(F.col("last_lc") == patterns.tidy_text(q.pattern).lower().rsplit("::", 1)[-1])


def search_classes(symbols: DataFrame, q: Criteria) -> DataFrame:
    return _limited(_narrow(symbols, q).filter(class_filter(q)), q)


def search_functions(symbols: DataFrame, q: Criteria, all_rows: DataFrame | None = None) -> DataFrame:
    """Functions that match; with a file filter and ``all_rows`` also superseded declarations."""
    src = all_rows if q.file_name and all_rows is not None else symbols
    return _limited(_narrow(src, q).filter(function_filter(q)), q)


def search_symbols(symbols: DataFrame, q: Criteria) -> DataFrame:
    """Classes first, then functions, ``max_results`` over both: a top-k by (section, name, usr)."""
    section = F.when(class_filter(q), 0).when(function_filter(q), 1)
    hits = _narrow(symbols, q).withColumn("section", section).filter("section IS NOT NULL")
    return hits if q.max_results is None else hits.orderBy("section", "qualified_name", "usr").limit(q.max_results)


def find_in_file(symbols: DataFrame, path: str, q: Criteria, boundary: bool = True, root: str = "") -> DataFrame:
    """Symbols of one file (by path or its end) or of all files a glob names, declared or defined there."""
    where = (lambda c: patterns.matches_glob(c, path, root)) if any(x in path for x in "*?[") else (lambda c: patterns.at_path(c, path, boundary))
    open_q = replace(q, project_only=False)
    return symbols.filter((class_filter(open_q) | function_filter(open_q)) & (where(F.col("file")) | F.coalesce(where(F.col("header_file")), F.lit(False))))


def path_suggestions(files: DataFrame, partial: str, k: int = 5) -> DataFrame:
    """The ``k`` paths most like ``partial`` with their scores."""
    low, path = partial.lower(), F.lower("file")
    base = F.substring_index(path, "/", -1)
    wanted = low.rstrip("/").rsplit("/", 1)[-1]
    parts = [p for p in dict.fromkeys(low.split("/")) if p]
    score = F.when(base == wanted, 100).when(base.contains(wanted), 50).when(path.contains(low), 30).otherwise(0)
    for p in parts:
        score = score + F.when(path.contains(p), 10).otherwise(0)
    return files.select("file").distinct().withColumn("score", score.cast("long")).filter("score > 0").orderBy(F.desc("score"), "file").limit(k)


def class_candidates(classes: DataFrame, name: str) -> DataFrame:
    """Rows a class name may mean: the exact simple name, else any case; a qualified name by its end."""
    simple = patterns.last_component(F.col("qualified_name"))
    if "::" in name:
        return classes.filter(patterns.matches_qualified(F.col("qualified_name"), name.removeprefix("::")))
    exact = classes.filter(simple == name)
    return exact if exact.limit(1).count() else classes.filter(F.lower(simple) == name.lower())


def ambiguous_names(classes: DataFrame) -> DataFrame:
    """(name, n_candidates, first_candidate) of the simple names that more than one class has."""
    by = classes.groupBy("name").agg(F.countDistinct("qualified_name").alias("n_candidates"), F.min("qualified_name").alias("first_candidate"))
    return by.filter("n_candidates > 1")


def class_methods(symbols: DataFrame) -> DataFrame:
    """Every method with the class its qualified name names, by equi-join on that class."""
    methods = symbols.filter(F.col("kind").isin(*FUNCTION_KINDS)).withColumn("owner", naming.namespace_of(F.col("qualified_name")))
    owners = symbols.filter(F.col("kind").isin(*CLASS_KINDS)).select(F.col("usr").alias("class_usr"), F.col("qualified_name").alias("owner"), F.col("file").alias("class_file"))
    return methods.filter("owner <> ''").join(owners, "owner")


def class_info(symbols: DataFrame) -> DataFrame:
    """(class_usr, n_methods, n_public, n_virtual, first_method) of every class."""
    count = lambda c: F.count(F.when(c, 1))
    line = F.coalesce("header_line", "line")
    return class_methods(symbols).groupBy("class_usr").agg(
        F.count(F.lit(1)).alias("n_methods"), count(F.col("access") == "public").alias("n_public"), count(F.col("is_virtual") | F.col("is_pure_virtual")).alias("n_virtual"), F.min(F.struct(line.alias("line"), F.col("name").alias("name"))).alias("m"),
    ).select("class_usr", "n_methods", "n_public", "n_virtual", F.col("m.name").alias("first_method"))


def files_containing(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(usr, n_files, n_references): files that define, declare or call each function."""
    funcs = symbols.filter(F.col("kind").isin(*FUNCTION_KINDS))
    own = funcs.select("usr", F.explode(F.array("file", "header_file")).alias("file"), F.lit(0).alias("ref"))
    calls = edges.groupBy(F.col("callee_usr").alias("usr"), "file").agg(F.count(F.lit(1)).alias("ref"))
    every = own.filter("file IS NOT NULL").unionByName(calls.join(funcs.select("usr"), "usr", "left_semi"))
    return every.groupBy("usr", "file").agg(F.sum("ref").alias("ref")).groupBy("usr").agg(F.count(F.lit(1)).alias("n_files"), F.sum("ref").alias("n_references"))


def token_table(symbols: DataFrame) -> DataFrame:
    """(token, usr): the words of every name, lower-case; what full-text search looks up."""
    words = F.regexp_extract_all("name", F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"))
    return symbols.select("usr", F.explode(F.array_distinct(F.transform(words, F.lower))).alias("token")).select("token", "usr")


def search_tokens(tokens: DataFrame, query: str) -> DataFrame:
    """usrs that have every word of ``query``; ``tok*`` asks for a prefix."""
    out = None
    for w in query.lower().split():
        hit = tokens.filter(F.col("token").startswith(w[:-1]) if w.endswith("*") else F.col("token") == w).select("usr").distinct()
        out = hit if out is None else out.join(hit, "usr", "left_semi")
    return out if out is not None else tokens.select("usr").distinct()


# --- results and what to say about them -----------------------------------

DETAIL_LEVELS = {"full": (), "no_docs": ("brief", "doc_comment"), "locations_only": ("brief", "doc_comment", "signature", "access", "bases"), "names_only": ("brief", "doc_comment", "signature", "access", "bases", "file", "line", "column_no", "start_line", "end_line", "header_file", "header_line")}


def with_detail(df: DataFrame, level: str = "full") -> DataFrame:
    return df.drop(*DETAIL_LEVELS[level])


def result_status(rows: DataFrame, total: int | None = None, partial: bool = False, large: int = LARGE) -> DataFrame:
    """One row (status, n_rows, total): partial before empty, truncated, large and normal."""
    n = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    t = F.lit(total).cast("long") if total is not None else F.col("n_rows")
    return n.withColumn("total", t).withColumn(
        "status", F.when(F.lit(partial), "partial").when(F.col("n_rows") == 0, "empty").when(F.col("total") > F.col("n_rows"), "truncated").when(F.col("n_rows") > large, "large").otherwise("normal")
    )


@dataclass(frozen=True)
class Fallback:
    """Why a search found nothing and what to try instead."""

    reason: str
    hint: str
    suggested: str | None = None
    alternatives: tuple[str, ...] = ()


def _names(symbols: DataFrame, cond: Column, k: int = HITS) -> tuple[str, ...]:
    return tuple(r[0] for r in symbols.filter(cond).select("qualified_name").distinct().orderBy("qualified_name").limit(k).collect())


def _sample_regex(symbols: DataFrame, p: str) -> tuple[str, ...]:
    """Up to ten names among the first two hundred that match (a sampling operator: the bound is the feature)."""
    if patterns.unsafe_because(p):
        return ()
    return tuple(r[0] for r in symbols.select("name").distinct().orderBy("name").limit(SAMPLE).filter(patterns.full_regex(F.col("name"), p)).limit(HITS).collect())


def explain_empty(symbols: DataFrame, p: str, file_name: str | None = None) -> Fallback | None:
    """The first explanation that fits: a signature, a bad expression, a qualified name, the case of a file."""
    lookup = lambda n: _names(symbols, F.col("name_lc") == n.lower())
    if patterns.looks_like_signature(p) and (name := patterns.identifier_of(p)):
        return Fallback("signature_in_pattern", "Search for the name alone.", name, lookup(name.rsplit("::", 1)[-1]))
    if patterns.is_pattern(p):
        tries = []
        if patterns.has_double_escapes(p):
            tries.append(("double_escapes", p.replace("\\\\", "\\")))
        if patterns.has_anchors(p):
            tries.append(("unnecessary_anchors", ".*" + patterns.without_anchors(p) + ".*"))
        if patterns.is_short_regex(p):
            tries.append(("pattern_too_short", p + ".*"))
        tries.append(("pattern_too_narrow", f".*{p}.*"))
        for reason, q in tries:
            if got := _sample_regex(symbols, q):
                return Fallback(reason, "Expressions match whole names.", q, got)
    if "::" in p:
        last = p.rsplit("::", 1)[-1]
        if got := lookup(last):
            return Fallback("qualified_name_not_found", "The last component exists elsewhere.", last, got)
    if file_name:
        base = file_name.rsplit("/", 1)[-1]
        path = F.substring_index(F.col("file"), "/", -1)
        got = tuple(r[0] for r in symbols.filter((F.lower(path) == base.lower()) & (path != base)).select("file").distinct().orderBy("file").limit(HITS).collect())
        if got:
            return Fallback("file_case_mismatch", "File names are case sensitive.", got[0], got)
    return None


def next_steps(n_results: int, filtered: bool = True, n_methods: int = 0, abstract: bool = False) -> list[str]:
    """Hints that go with a result."""
    out = []
    if n_results > 3 and not filtered:
        out.append("narrow the search by file_name or namespace")
    if abstract:
        out.append("look at the derived classes: this one is abstract")
    if n_methods > 10:
        out.append("ask for one method by name: there are many")
    return out
