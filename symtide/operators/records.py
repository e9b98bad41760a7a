"""Result records and look-ups over the maintained tables: what a tool hands out about a symbol, a file or a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import naming, patterns
from .relations import CLASS_KINDS, FUNCTION_KINDS

#: The fields of a whole record, as the index names them.
FIELDS = (
    "usr name qualified_name kind file line column_no signature is_project namespace access parent_class bases is_template template_kind start_line end_line header_file header_line "
    "is_definition is_virtual is_pure_virtual is_const is_static brief doc_comment created_at updated_at removed_at"
).split()


def symbol_records(symbols: DataFrame) -> DataFrame:
    """Every symbol with all fields and ``specialization_of``: the qualified name of the template that its USR specialises."""
    made = symbols.select(*FIELDS, naming.template_base_of_usr(F.col("usr")).alias("base_name"), naming.namespace_of(F.col("qualified_name")).alias("scope"))
    primary = symbols.filter(F.col("kind") == "class_template").select(F.col("name").alias("base_name"), naming.namespace_of(F.col("qualified_name")).alias("scope"), F.col("qualified_name").alias("specialization_of"))
    primary = primary.groupBy("base_name", "scope").agg(F.min("specialization_of").alias("specialization_of"))
    return made.join(primary, ["base_name", "scope"], "left").drop("base_name", "scope")


def class_results(symbols: DataFrame) -> DataFrame:
    """What a class search shows."""
    c = symbols.filter(F.col("kind").isin(*CLASS_KINDS))
    return c.select("qualified_name", "namespace", "kind", "file", "line", "is_project", F.array_join("bases", ", ").alias("bases"), naming.class_prototype(F.col("qualified_name"), F.col("kind"), F.col("bases")).alias("prototype"), "template_kind", "usr")


def function_results(symbols: DataFrame) -> DataFrame:
    """What a function search shows."""
    f = symbols.filter(F.col("kind").isin(*FUNCTION_KINDS))
    return f.select("qualified_name", "namespace", "kind", "file", "line", "is_project", "parent_class", naming.function_prototype().alias("prototype"), F.array_join(naming.attributes(), ",").alias("attributes"), "usr")


def compact_records(symbols: DataFrame) -> DataFrame:
    """Records as JSON without the fields that are null."""
    return symbols.select("usr", F.to_json(F.struct("qualified_name", "kind", "file", "line", "parent_class", "signature", "header_file", "header_line"), {"ignoreNullFields": "true"}).alias("record"))


# --- look-ups -------------------------------------------------------------


def resolve_usrs(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(usr, qualified_name, is_project) of each asked ``usr``; one the index does not hold is none of the project's."""
    known = symbols.select("usr", "qualified_name", "is_project")
    return asked.join(known, "usr", "left").select("usr", "qualified_name", F.coalesce("is_project", F.lit(False)).alias("is_project"))


def lookup_names(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(asked, name): the name itself if the index has it, else the first that differs in case only."""
    names = symbols.select("name", "name_lc").filter("name IS NOT NULL").distinct()
    exact = asked.join(names.select(F.col("name").alias("asked"), F.lit(True).alias("there")), "asked", "left")
    other = names.groupBy("name_lc").agg(F.min("name").alias("other"))
    met = exact.withColumn("name_lc", F.lower("asked")).join(other, "name_lc", "left")
    return met.select("asked", F.when(F.col("there"), F.col("asked")).otherwise(F.col("other")).alias("name")).filter("name IS NOT NULL")


def at_location(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """USRs of search results (name, file, line) that come without one."""
    return hits.join(symbols.select("usr", patterns.last_component(F.col("qualified_name")).alias("name"), "file", "line"), ["name", "file", "line"]).select(*hits.columns, "usr")


def numbered(sites: DataFrame, key: str) -> DataFrame:
    """Call sites of each ``key`` with their place in order of file, line and column.

    The number is a count of smaller sites: files are counted first, so no window holds a whole key.
    """
    per = sites.groupBy(key, "file").agg(F.count(F.lit(1)).alias("m"))
    before = W.partitionBy(key).orderBy(F.col("file").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    starts = per.select(key, F.col("file").alias("f"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    other = "callee_usr" if key == "caller_usr" else "caller_usr"
    inside = W.partitionBy(key, "file").orderBy("line", "column_no", other)
    met = sites.withColumn("__n", F.row_number().over(inside)).withColumnRenamed(key, "__k").join(starts.withColumnRenamed(key, "__k2"), (F.col("__k") == F.col("__k2")) & F.col("file").eqNullSafe(F.col("f")))
    return met.select(F.col("__k").alias(key), other, "file", "line", "column_no", (F.col("start") + F.col("__n")).cast("long").alias("place"))


def template_mediated(call_sites: DataFrame, callers: DataFrame) -> DataFrame:
    """(caller_usr, callee_usr, n, first_site) of the calls through project types that ``callers`` (usr) make."""
    t = call_sites.filter((F.size("template_project_types") > 0) & F.col("callee_usr").isNotNull())
    t = t.join(callers.select(F.col("usr").alias("caller_usr")), "caller_usr", "left_semi")
    return t.groupBy("caller_usr", "callee_usr").agg(F.count(F.lit(1)).alias("n"), F.min_by("call_site_id", F.struct("file", "line", "call_site_id")).alias("first_site"))


# --- classes --------------------------------------------------------------


def scopes_of(symbols: DataFrame) -> DataFrame:
    """(usr, file, scope): every symbol under each scope that its qualified name names, and under its parent class."""
    parts = F.split("qualified_name", "::")
    ways = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "::"))).otherwise(F.array().cast("array<string>"))
    return symbols.select("usr", "file", F.explode(F.array_distinct(F.array_compact(F.concat(ways, F.array("parent_class", "qualified_name"))))).alias("scope"))


def class_reference_files(symbols: DataFrame) -> DataFrame:
    """(class_usr, n_files): how many files hold the class or a symbol under it."""
    owners = symbols.filter(F.col("kind").isin(*CLASS_KINDS)).select(F.col("usr").alias("class_usr"), F.col("qualified_name").alias("scope"))
    return scopes_of(symbols).filter("file IS NOT NULL").join(owners, "scope").select("class_usr", "file").distinct().groupBy("class_usr").agg(F.count(F.lit(1)).alias("n_files"))


def chosen_classes(classes: DataFrame, parts: int = 2) -> DataFrame:
    """(suffix, usr, n_candidates): of the classes that end in the same ``parts`` components the one that a qualified look-up takes:
    a definition, then one with bases, then the longest, then the first by name."""
    tail = F.split("qualified_name", "::")
    key = F.lower(F.array_join(F.slice(tail, -F.least(F.size(tail), F.lit(parts)), F.least(F.size(tail), F.lit(parts))), "::"))
    rank = F.struct((~F.coalesce("is_definition", F.lit(False))).alias("a"), (F.size("bases") == 0).alias("b"), F.coalesce(F.col("start_line") - F.col("end_line"), F.lit(1)).alias("c"), F.col("qualified_name").alias("d"), F.col("usr").alias("e"))
    return classes.filter("qualified_name IS NOT NULL").groupBy(key.alias("suffix")).agg(F.min_by("usr", rank).alias("usr"), F.count(F.lit(1)).alias("n_candidates"))


def ordered_methods(symbols: DataFrame) -> DataFrame:
    """(class_usr, place, usr, name): the methods of every class in order of their lines."""
    from .search import class_methods

    at = W.partitionBy("class_usr").orderBy(F.coalesce("header_line", "line").asc_nulls_first(), "name", "usr")
    return class_methods(symbols).select("class_usr", F.row_number().over(at).alias("place"), "usr", "name")


def scoped_signatures(symbols: DataFrame) -> DataFrame:
    """(usr, class_name, signature): signatures of methods with the simple name of their class before the name."""
    owner = patterns.last_component(F.col("parent_class"))
    f = symbols.filter(F.col("kind").isin(*FUNCTION_KINDS) & (F.coalesce("signature", F.lit("")) != ""))
    return f.select("usr", owner.alias("class_name"), F.when(owner != "", naming.scoped_signature(F.col("signature"), F.col("name"), owner)).otherwise(F.col("signature")).alias("signature"))


def of_class(name: str) -> Column:
    """Does a function belong to the class ``name``: by its parent, or by a scope in its qualified name."""
    q = F.col("qualified_name")
    return F.coalesce((F.col("parent_class") == name) | F.col("parent_class").endswith("::" + name), F.lit(False)) | q.startswith(name + "::") | q.contains(f"::{name}::")


def readable_signature(signature: Column, name: Column) -> Column:
    """``ret name(params)quals`` out of a type text ``ret (params)quals``; null without parentheses."""
    at = F.instr(signature, "(")
    return F.when(at > 0, F.concat(F.rtrim(F.substring(signature, F.lit(1), at - 1)), F.lit(" "), name, F.substring(signature, at, F.length(signature))))


def merged_index(symbols: DataFrame) -> DataFrame:
    """(name, section, usr): one entry for each simple name; functions stand before classes of the same name."""
    section = F.when(F.col("kind").isin(*FUNCTION_KINDS), "function").when(F.col("kind").isin(*CLASS_KINDS), "class")
    s = symbols.withColumn("section", section).filter("section IS NOT NULL AND name IS NOT NULL")
    return s.groupBy("name").agg(F.min_by(F.struct("section", "usr"), F.struct((F.col("section") == "class").alias("k"), F.col("qualified_name"), F.col("usr"))).alias("s")).select("name", "s.section", "s.usr")


def hierarchy_nodes(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, kind, n_bases, n_derived, is_unresolved, is_dependent_type) of every class and every base that is none."""
    known = symbols.filter(F.col("kind").isin(*CLASS_KINDS)).select(F.col("usr"), F.col("qualified_name").alias("name"), "kind")
    up = edges.groupBy(F.col("derived_usr").alias("usr")).agg(F.count(F.lit(1)).alias("n_bases"))
    down = edges.filter("base_usr IS NOT NULL").select(F.col("base_usr").alias("usr"), "derived_usr").distinct().groupBy("usr").agg(F.count(F.lit(1)).alias("n_derived"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    here = known.join(up, "usr", "left").join(down, "usr", "left").select("name", "kind", zero("n_bases").alias("n_bases"), zero("n_derived").alias("n_derived"), F.lit(False).alias("is_unresolved"), F.lit(False).alias("is_dependent_type"))
    dependent = F.col("name").rlike(r"^(?:typename\s|type-parameter-\d+-\d+|[A-Z]\w?$|.*<[^>]*\b(?:type-parameter-\d+-\d+|[TUVW])\b)")
    other = edges.filter("base_usr IS NULL").groupBy(F.col("base_raw").alias("name")).agg(F.countDistinct("derived_usr").alias("n_derived"))
    return here.unionByName(other.select("name", F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("n_bases"), "n_derived", (~dependent).alias("is_unresolved"), dependent.alias("is_dependent_type")))


def capped_hierarchies(pairs: DataFrame, max_nodes: int) -> DataFrame:
    """The first ``max_nodes`` of each start's hierarchy (start, node, depth) by depth and node, and whether more remain.

    Whole levels are counted first; only the level that the cap cuts through is put in order.
    """
    per = pairs.groupBy("start", "depth").agg(F.count(F.lit(1)).alias("m"))
    upto = W.partitionBy("start").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    kept = per.withColumn("upto", F.sum("m").over(upto)).withColumn("total", F.sum("m").over(W.partitionBy("start"))).filter(F.col("upto") - F.col("m") < max_nodes)
    met = pairs.join(kept, ["start", "depth"])
    whole = met.filter(F.col("upto") <= max_nodes)
    cut = met.filter(F.col("upto") > max_nodes).withColumn("r", F.row_number().over(W.partitionBy("start", "depth").orderBy("node"))).filter(F.col("r") + F.col("upto") - F.col("m") <= max_nodes).drop("r")
    return whole.unionByName(cut).select("start", "node", "depth", (F.col("total") > max_nodes).alias("truncated"))


def header_lines(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, name, line): forward declarations of what the hierarchy does not hold, as its C++ text begins."""
    missing = edges.filter("base_usr IS NULL").select(F.col("base_raw").alias("name")).distinct()
    return missing.select(F.lit(0).alias("section"), "name", F.concat(F.lit("class "), naming.without_template(F.col("name")), F.lit(";  // not in the index")).alias("line"))


#: The texts of a hierarchy that could not be given, by format.
ERRORS = {"json": '{{"error": "{0}"}}', "compact": '{{"error": "{0}"}}', "cpp": "// Error: {0}", "cpp_with_meta": "// Error: {0}"}


def hierarchy_error(message: str, output_format: str = "json") -> str:
    return ERRORS[output_format].format(message.replace('"', '\\"') if "json" in ERRORS[output_format] or output_format in ("json", "compact") else message)
