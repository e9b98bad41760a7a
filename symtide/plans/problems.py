"""Queries of the general training-data problems, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, eager, hierarchy, multivalue, nested, orphans
from ..session import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.symbol_hierarchy(table(spark, d, "symbols")).select("usr", "root_usr", "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every usr with its path from the root as text."""
    return hierarchy.symbol_hierarchy(table(spark, d, "symbols"), paths=True).select("usr", "root_usr", "depth", F.array_join("path", " > ").alias("path"), "on_cycle")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """How many usrs hang below each usr, at any distance, and how far down they reach."""
    links = materialize(hierarchy.symbol_links(table(spark, d, "symbols")), "parents")
    return hierarchy.descendant_counts(links).withColumnRenamed("id", "usr")


def p1_descendant_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every usr with each usr that hangs below it, and how far down: the descendants that p1_descendants counts."""
    nodes = hierarchy.symbol_hierarchy(table(spark, d, "symbols"), paths=True).withColumnsRenamed({"usr": "id", "root_usr": "root"})
    return hierarchy.descendants(materialize(nodes, "nodes")).select(F.col("ancestor").alias("usr"), F.col("descendant").alias("descendant_usr"), "distance")


def p1_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The cycles: one row per usr on one, with the cycle's smallest usr."""
    return hierarchy.symbol_hierarchy(table(spark, d, "symbols")).filter("on_cycle").select("usr", F.col("root_usr").alias("cycle_usr"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return eager.dominant_keys(table(spark, d, "call_sites")).select("side", "usr")


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    return eager.key_profile(table(spark, d, "call_sites"))


def p2_two_step_chains(spark: SparkSession, d: str) -> DataFrame:
    return eager.two_step_chains(table(spark, d, "call_sites"))


def p2_kind_matrix(spark: SparkSession, d: str) -> DataFrame:
    return eager.kind_matrix(table(spark, d, "call_sites"), table(spark, d, "symbols"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.capture_changes(table(spark, d, "file_metadata"), table(spark, d, "index_runs"), batches=2).select("run_id", "file_path")


def p3_replayed(spark: SparkSession, d: str) -> DataFrame:
    """p3_found with a failure: the second of three batches dies before its commit and another process replays it."""
    log, runs = table(spark, d, "file_metadata"), table(spark, d, "index_runs")
    arrivals = changes.arrivals_of(log, 3)
    first = changes.ChangeCapture(spark, arrivals=arrivals)
    first.run(log, runs)
    try:
        first.run(log, runs, fail_before_commit=True)
    except RuntimeError:
        pass
    second = changes.ChangeCapture(spark, first.dir, arrivals=arrivals)
    while second.run(log, runs):
        pass
    return second.changes().select("run_id", "file_path")


def p3_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Added and modified files of each succeeded run."""
    got = changes.capture_changes(table(spark, d, "file_metadata"), table(spark, d, "index_runs"))
    n = lambda kind: F.count(F.when(F.col("change") == kind, 1))
    return got.groupBy("run_id").agg(n("added").alias("n_added"), n("modified").alias("n_modified"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    got = nested.nodes(table(spark, d, "lms_conversations"), with_bodies=False)
    return got.filter(F.col("node_level").isin(*nested.LEVELS)).select("conv_id", "node_level", "node_path")


def p5_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of an object with its parent, ordinal and identity."""
    return nested.nodes(table(spark, d, "lms_conversations")).drop("body")


def p5_objects(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct object once."""
    return nested.objects(nested.nodes(table(spark, d, "lms_conversations")))


def p5_gen_info(spark: SparkSession, d: str) -> DataFrame:
    """The genInfo of every step with its model and figures."""
    got = nested.nodes(table(spark, d, "lms_conversations")).filter("node_level = 'gen_info'")
    of = lambda path: F.get_json_object("body", path)
    return got.select("conv_id", "node_path", "parent_path", "node_hash", of("$.identifier").alias("model"), of("$.stats.stopReason").alias("stop_reason"), of("$.stats.tokensPerSecond").try_cast("double").alias("tokens_per_second"), of("$.stats.promptTokensCount").try_cast("long").alias("prompt_tokens"))


def p5_tools(spark: SparkSession, d: str) -> DataFrame:
    """The tools that genInfo names, linked to their step."""
    got = nested.nodes(table(spark, d, "lms_conversations")).filter("node_level = 'tool'")
    name = F.coalesce(F.get_json_object("body", "$.function.name"), F.get_json_object("body", "$.name"))
    return got.select("conv_id", "node_path", "parent_path", "ordinal", "node_hash", name.alias("tool_name"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.call_orphans(table(spark, d, "call_sites"), table(spark, d, "symbols"), table(spark, d, "dependency_symbols"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("call_site_id", "side", "reason")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = multivalue.packed_rows(table(spark, d, "compile_commands"), table(spark, d, "symbols"))
    return multivalue.split_values(rows).select("source_table", "record_key", "pos", "item")


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_descendant_pairs, p1_cycles, p2_found, p2_profile, p2_two_step_chains, p2_kind_matrix, p3_found, p3_replayed, p3_run_summary, p5_found, p5_bridge, p5_objects, p5_gen_info, p5_tools, p6_found, p6_report, p7_found)}

# --- SQL ------------------------------------------------------------------

_SIDES = "SELECT 'caller' AS side, caller_usr AS usr, callee_usr AS partner, file FROM call_sites UNION ALL SELECT 'callee', callee_usr, caller_usr, file FROM call_sites"
_FULL = r"regexp_matches({0}, '\S')"

_P1 = r"""
WITH RECURSIVE rows_that_count AS (
  SELECT usr, kind, qualified_name, parent_class, base_classes FROM (
    SELECT *, row_number() OVER (PARTITION BY usr ORDER BY coalesce(is_definition, false) DESC, qualified_name DESC) AS rn FROM symbols WHERE usr IS NOT NULL) WHERE rn = 1),
named AS (
  SELECT usr, kind IN ('class', 'struct', 'class_template') AS is_class,
    regexp_replace(regexp_replace(regexp_replace(qualified_name, '^\s*(?:::)?\s*', ''), '(?s)<.*$', ''), '\s+$', '') AS own,
    CASE WHEN regexp_matches(coalesce(parent_class, ''), '\S')
      THEN regexp_replace(regexp_replace(regexp_replace(parent_class, '^\s*(?:::)?\s*', ''), '(?s)<.*$', ''), '\s+$', '')
      ELSE nullif(regexp_extract(coalesce(base_classes, ''), '^[^\w]*([\w:]+)', 1), '') END AS pname
  FROM rows_that_count),
links AS (SELECT n.usr, min(c.usr) AS parent FROM named n LEFT JOIN named c ON c.is_class AND c.own = n.pname AND c.own <> '' GROUP BY n.usr),
down AS (
  SELECT usr, usr AS root_usr, 0 AS depth FROM links WHERE parent IS NULL
  UNION ALL SELECT l.usr, d.root_usr, d.depth + 1 FROM links l JOIN down d ON l.parent = d.usr),
loose AS (SELECT l.* FROM links l LEFT JOIN down d ON d.usr = l.usr WHERE d.usr IS NULL),
walk AS (
  SELECT usr AS start_usr, parent AS node, 1 AS step FROM loose
  UNION ALL SELECT w.start_usr, l.parent, w.step + 1 FROM walk w JOIN loose l ON l.usr = w.node WHERE w.step <= (SELECT count(*) FROM loose)),
-- what a loose usr still meets after as many steps as there are loose usrs lies on its cycle
ring AS (SELECT DISTINCT node AS usr FROM walk WHERE step > (SELECT count(*) FROM loose)),
ring_of AS (SELECT w.start_usr AS usr, min(w.node) AS low FROM walk w JOIN ring r ON r.usr = w.node GROUP BY w.start_usr)
"""

ORACLE = {
    "p1_found": _P1 + "SELECT usr, root_usr, CAST(depth AS INTEGER) AS depth FROM down UNION ALL SELECT usr, low, CAST(-1 AS INTEGER) FROM ring_of",
    "p1_paths": _P1 + """, cut AS (SELECT usr, CASE WHEN usr NOT IN (SELECT low FROM ring_of) THEN parent END AS parent FROM links),
      dn AS (SELECT usr, usr AS path FROM cut WHERE parent IS NULL UNION ALL SELECT c.usr, dn.path || ' > ' || c.usr FROM cut c JOIN dn ON c.parent = dn.usr)
      SELECT dn.usr, coalesce(d.root_usr, o.low) AS root_usr, CAST(coalesce(d.depth, -1) AS INTEGER) AS depth, dn.path, r.usr IS NOT NULL AS on_cycle FROM dn LEFT JOIN down d ON d.usr = dn.usr LEFT JOIN ring_of o ON o.usr = dn.usr LEFT JOIN ring r ON r.usr = dn.usr""",
    "p1_descendants": _P1 + """, up(start, node, d) USING KEY (start, node) AS (SELECT usr, parent, 1 FROM links WHERE parent IS NOT NULL
      UNION (SELECT up.start, l.parent, min(up.d + 1) FROM up JOIN links l ON l.usr = up.node LEFT JOIN recurring.up AS x ON x.start = up.start AND x.node = l.parent WHERE l.parent IS NOT NULL AND x.d IS NULL GROUP BY 1, 2))
      SELECT node AS usr, count(*) AS n_descendants, CAST(max(d) AS INTEGER) AS reach FROM up WHERE start <> node GROUP BY 1""",
    "p1_cycles": _P1 + "SELECT r.usr, o.low AS cycle_usr FROM ring r JOIN ring_of o ON o.usr = r.usr",
    "p2_found": f"SELECT side, usr FROM ({_SIDES}) WHERE {_FULL.format('usr')} GROUP BY side, usr HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM call_sites)",
    "p2_profile": f"""SELECT side, usr, count(*) AS n_sites, count(DISTINCT CASE WHEN {_FULL.format('partner')} THEN partner END) AS n_partners, count(DISTINCT file) AS n_files,
      count(*) * 100 >= 2 * (SELECT count(*) FROM call_sites) AS dominant FROM ({_SIDES}) WHERE {_FULL.format('usr')} GROUP BY side, usr""",
    "p2_two_step_chains": f"""SELECT a.usr, a.n * b.n AS n_chains FROM (SELECT callee_usr AS usr, count(*) AS n FROM call_sites WHERE {_FULL.format('callee_usr')} GROUP BY 1) a
      JOIN (SELECT caller_usr AS usr, count(*) AS n FROM call_sites WHERE {_FULL.format('caller_usr')} GROUP BY 1) b ON a.usr = b.usr""",
    "p2_kind_matrix": """SELECT a.kind AS caller_kind, b.kind AS callee_kind, CAST(count(*) AS BIGINT) AS n_rows FROM call_sites c JOIN symbols a ON a.usr = c.caller_usr JOIN symbols b ON b.usr = c.callee_usr GROUP BY 1, 2""",
    "p6_found": f"""WITH refs AS (
      SELECT call_site_id, 'caller' AS side, caller_usr AS usr, created_at AS t FROM call_sites UNION ALL SELECT call_site_id, 'callee', callee_usr, created_at FROM call_sites),
    judged AS (
      SELECT r.call_site_id, r.side, count(s.usr) AS n, coalesce(bool_or(s.created_at <= r.t AND (s.removed_at IS NULL OR s.removed_at > r.t)), false) AS alive,
        coalesce(bool_and(coalesce(s.created_at > r.t, false)), false) AS late
      FROM refs r LEFT JOIN symbols s ON s.usr = r.usr
      WHERE {_FULL.format('r.usr')} AND r.usr NOT IN (SELECT usr FROM dependency_symbols WHERE usr IS NOT NULL) GROUP BY r.call_site_id, r.side)
    SELECT call_site_id, side, CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS reason FROM judged WHERE NOT alive""",
}

ORACLE["p1_descendant_pairs"] = ORACLE["p1_descendants"].partition("SELECT node AS usr")[0] + "SELECT node AS usr, start AS descendant_usr, CAST(d AS INTEGER) AS distance FROM up WHERE start <> node"

_P3 = """WITH good AS (SELECT run_id, row_number() OVER (ORDER BY run_id) AS k FROM index_runs WHERE status = 'succeeded'),
rows_that_count AS (
  SELECT file_path, indexed_at, record_id, lower(file_hash) AS fh, lower(coalesce(compile_args_hash, '')) AS ah, (SELECT min(g.k) FROM good g WHERE g.run_id >= m.run_id) AS k
  FROM file_metadata m WHERE coalesce(success, true) AND file_hash IS NOT NULL AND file_path IS NOT NULL),
states AS (
  SELECT g.k, g.run_id, r.file_path, max_by(r.fh || '/' || r.ah, (r.indexed_at, r.record_id)) AS state FROM good g JOIN rows_that_count r ON r.k <= g.k GROUP BY 1, 2, 3)
"""
ORACLE["p3_found"] = _P3 + "SELECT a.run_id, a.file_path FROM states a LEFT JOIN states b ON b.k = a.k - 1 AND b.file_path = a.file_path WHERE b.state IS NULL OR b.state <> a.state"
ORACLE["p3_replayed"] = ORACLE["p3_found"]
ORACLE["p3_run_summary"] = _P3 + """SELECT a.run_id, count(CASE WHEN b.state IS NULL THEN 1 END) AS n_added, count(CASE WHEN b.state <> a.state THEN 1 END) AS n_modified
FROM states a LEFT JOIN states b ON b.k = a.k - 1 AND b.file_path = a.file_path WHERE b.state IS NULL OR b.state <> a.state GROUP BY 1"""
ORACLE["p6_report"] = "WITH found AS (" + ORACLE["p6_found"] + """) SELECT f.side, f.reason, CAST(date_trunc('month', c.created_at) AS DATE) AS month, count(*) AS n_refs,
count(DISTINCT CASE WHEN f.side = 'caller' THEN c.caller_usr ELSE c.callee_usr END) AS n_usrs FROM found f JOIN call_sites c USING (call_site_id) GROUP BY 1, 2, 3"""
