"""The relations of the code index, taken from the tables of a data directory.

Class and function facts come from the index's own tables. Type aliases, include
edges and tool calls have no table there; they are fixed projections of the star
schema, which SQL can state as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import base_list
from ..functions.patterns import last_component, tidy
from ..session import maintained, table

CLASS_KINDS = ("class", "struct", "class_template")
FUNCTION_KINDS = ("function", "method", "function_template")
_COLUMNS = (
    "name qualified_name kind file line column_no signature is_project namespace access parent_class base_classes is_template template_kind start_line end_line "
    "header_file header_line is_definition is_virtual is_pure_virtual is_const is_static brief doc_comment created_at updated_at removed_at"
).split()


def rank_key(richer: bool = True) -> Column:
    """What makes one row of a symbol win over another: a definition, then bases and span, then a fixed order."""
    base = [F.coalesce("is_definition", F.lit(False)).cast("int").alias("k0")]
    if richer:
        base += [(F.size(base_list(F.col("base_classes"))) > 0).cast("int").alias("k1"), (F.col("end_line") - F.col("start_line")).alias("k2")]
    tail = ("created_at", "updated_at", "removed_at", "file", "line", "column_no", "doc_comment", "brief", "signature", "base_classes", "parent_class")
    return F.struct(*base, *(F.col(c).alias(f"t_{c}") for c in tail))


def definition_wins(rows: DataFrame, keys: tuple[str, ...] = ("usr",), richer: bool = True) -> DataFrame:
    """One row per key: the definition, among several the richer one, ties by a fixed order.

    The winner is a partial aggregate, so many copies of one symbol never meet in one task.
    """
    rest = [c for c in rows.columns if c not in keys]
    won = rows.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), rank_key(richer)).alias("s"))
    return won.select(*keys, "s.*")


def all_symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").select("usr", *_COLUMNS)


def resolved(rows: DataFrame) -> DataFrame:
    """One row per usr, with the list of bases and the lower-case names that searches look up."""
    names = {"bases": base_list(F.col("base_classes")), "name_lc": F.lower("name"), "qualified_name_lc": F.lower("qualified_name"), "last_lc": last_component(F.lower(tidy("qualified_name")))}
    return definition_wins(rows).withColumns(names)


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """The index proper, a maintained table in ranges of the last name component, so a look-up reads few row groups."""
    return maintained(spark, d, "symbols", ("symbols",), lambda: resolved(all_symbols(spark, d)).repartitionByRange("last_lc", "usr").sortWithinPartitions("last_lc", "usr"))


def classes(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).filter(F.col("kind").isin(*CLASS_KINDS))


def functions(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).filter(F.col("kind").isin(*FUNCTION_KINDS))


def distinct_sites(call_sites: DataFrame) -> DataFrame:
    """Call sites once per caller, callee, file, line and column."""
    return (
        call_sites.filter(F.col("caller_usr").rlike(r"\S") & F.col("callee_usr").rlike(r"\S"))
        .groupBy("caller_usr", "callee_usr", "file", "line", "column_no")
        .agg(F.max("display_name").alias("display_name"), F.max(F.coalesce(F.size("template_project_types") > 0, F.lit(False))).alias("templated"))
    )


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct call site with what is known of its callee; a maintained table in order of callers."""
    build = lambda: graphs.known_callees(distinct_sites(table(spark, d, "call_sites")), symbols(spark, d)).repartitionByRange("caller_usr", "callee_usr", "file", "line").sortWithinPartitions("caller_usr", "file", "line")
    return maintained(spark, d, "edges", ("call_sites", "symbols"), build)


def call_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every caller and callee once, with the names and scopes of both ends; a maintained table in order of callees."""
    build = lambda: graphs.named_pairs(call_edges(spark, d), symbols(spark, d)).repartitionByRange("callee_usr", "caller_usr").sortWithinPartitions("callee_usr", "caller_usr")
    return maintained(spark, d, "pairs", ("call_sites", "symbols"), build)


def inherits(spark: SparkSession, d: str) -> DataFrame:
    """The inheritance edges of all classes, a maintained table."""
    return maintained(spark, d, "inherits", ("symbols",), lambda: graphs.inherits(classes(spark, d)).repartitionByRange("derived_usr").sortWithinPartitions("derived_usr"))


def ancestry(spark: SparkSession, d: str) -> DataFrame:
    """(node, above, depth): every class with all classes above it, a maintained table."""
    build = lambda: graphs.closure(inherits(spark, d).filter("base_usr IS NOT NULL"), "derived_usr", "base_usr").repartitionByRange("node", "above").sortWithinPartitions("node")
    return maintained(spark, d, "ancestry", ("symbols",), build)


def aliases(spark: SparkSession, d: str) -> DataFrame:
    """Type aliases: many alias names for each canonical type."""
    c = table(spark, d, "customer")
    return c.select(
        F.concat(F.lit("Alias_"), F.col("c_custkey")).alias("alias_name"),
        F.concat(F.lit("ns"), F.col("c_custkey") % 7, F.lit("::Alias_"), F.col("c_custkey")).alias("qualified_name"),
        F.concat(F.lit("app::Type_"), F.col("c_nationkey")).alias("canonical_type"),
        F.when(F.col("c_custkey") % 3 == 0, "typedef").otherwise("using").alias("alias_kind"),
        F.concat(F.lit("src/"), F.col("c_mktsegment"), F.lit(".h")).alias("file"),
    )


def includes(spark: SparkSession, d: str) -> DataFrame:
    """Include edges between files, each once; as many files as there are customers and tens of orders."""
    o = table(spark, d, "orders")
    e = o.select(F.concat(F.lit("f"), "o_custkey", F.lit(".h")).alias("source_file"), F.concat(F.lit("f"), F.floor(F.col("o_orderkey") / 4), F.lit(".h")).alias("included_file"))
    return e.filter(F.col("source_file") != F.col("included_file")).distinct()


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Logged tool calls: tool, session, time and number of results."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"), F.col("user_id").alias("session"), F.col("ts"),
        F.when(F.col("value") < 5, 0).otherwise(F.floor("value")).cast("long").alias("result_count"), F.col("value").alias("wall"),
    )


# --- the same relations as SQL --------------------------------------------

_NAME_SQL = r"(?:::)?[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*(?:<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)?"
_BASES_SQL = f"regexp_extract_all(coalesce(base_classes, ''), '{_NAME_SQL}')"
ORDER_SQL = f"""coalesce(is_definition, false) DESC, (len({_BASES_SQL}) > 0) DESC, (end_line - start_line) DESC NULLS LAST, created_at DESC NULLS LAST, updated_at DESC NULLS LAST,
 removed_at DESC NULLS LAST, file DESC NULLS LAST, line DESC NULLS LAST, column_no DESC NULLS LAST, doc_comment DESC NULLS LAST, brief DESC NULLS LAST, signature DESC NULLS LAST,
 base_classes DESC NULLS LAST, parent_class DESC NULLS LAST"""
SYM = f"""sym AS (SELECT *, {_BASES_SQL} AS bases, lower(name) AS name_lc, lower(qualified_name) AS qualified_name_lc FROM
 (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY {ORDER_SQL}) AS rn FROM symbols WHERE usr IS NOT NULL) WHERE rn = 1)"""
CLS = SYM + ", cls AS (SELECT * FROM sym WHERE kind IN ('class', 'struct', 'class_template'))"
FUN = SYM + ", fun AS (SELECT * FROM sym WHERE kind IN ('function', 'method', 'function_template'))"
EDGES = r"""edges AS (SELECT caller_usr, callee_usr, file, line, column_no, max(display_name) AS display_name, max(coalesce(len(template_project_types) > 0, false)) AS templated
 FROM call_sites WHERE regexp_matches(caller_usr, '\S') AND regexp_matches(callee_usr, '\S') GROUP BY ALL)"""
ALIASES = """aliases AS (SELECT 'Alias_' || c_custkey AS alias_name, 'ns' || (c_custkey % 7) || '::Alias_' || c_custkey AS qualified_name, 'app::Type_' || c_nationkey AS canonical_type,
 CASE WHEN c_custkey % 3 = 0 THEN 'typedef' ELSE 'using' END AS alias_kind, 'src/' || c_mktsegment || '.h' AS file FROM customer)"""
INCLUDES = "includes AS (SELECT DISTINCT * FROM (SELECT 'f' || o_custkey || '.h' AS source_file, 'f' || (o_orderkey // 4) || '.h' AS included_file FROM orders) WHERE source_file <> included_file)"
CALLS = "calls AS (SELECT event_id AS call_id, event_type AS tool, user_id AS session, ts, CAST(CASE WHEN value < 5 THEN 0 ELSE floor(value) END AS BIGINT) AS result_count, value AS wall FROM events)"

from . import graphs  # noqa: E402  (graphs needs none of this module)
