"""Queries of upkeep, increments and telemetry over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arguments import command_words
from ..operators import increments, search, telemetry, upkeep
from ..operators import relations as rel
from ..operators.relations import CALLS, EDGES, INCLUDES, SYM
from ..session import table
from ..sources import tables
from .reading import CC, WORDS_SQL, _commands
from .reference import _REC, _records

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- writes by file -------------------------------------------------------

_META = "meta AS (SELECT file_path AS path, max(symbol_count) AS symbol_count, arg_min(lower(compile_args_hash), record_id) AS args_hash FROM file_metadata WHERE record_id % 2 = 0 AND file_path IS NOT NULL GROUP BY 1), fresh AS (SELECT file_path AS path, arg_max_null(lower(compile_args_hash), record_id) AS args_hash FROM file_metadata WHERE record_id % 3 = 0 AND file_path IS NOT NULL GROUP BY 1)"


def _meta(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = table(s, d, "file_metadata").filter("file_path IS NOT NULL").withColumn("a", F.lower("compile_args_hash"))
    old = m.filter("record_id % 2 = 0").groupBy(F.col("file_path").alias("path")).agg(F.max("symbol_count").alias("symbol_count"), F.min_by("a", F.when(F.col("a").isNotNull(), F.col("record_id"))).alias("args_hash"))
    return old, m.filter("record_id % 3 = 0").groupBy(F.col("file_path").alias("path")).agg(F.max_by("a", "record_id").alias("args_hash"))


@query(f"WITH {_META} SELECT coalesce(m.path, f.path) AS path, m.symbol_count, CASE WHEN f.path IS NOT NULL THEN f.args_hash ELSE m.args_hash END AS args_hash FROM meta m FULL JOIN fresh f ON f.path = m.path")
def argument_hashes_set(s: SparkSession, d: str) -> DataFrame:
    """Argument hashes of later deliveries written over those of earlier ones."""
    return upkeep.with_argument_hashes(*_meta(s, d))


@query(f"WITH {_META} SELECT path, symbol_count, CAST(NULL AS VARCHAR) AS args_hash FROM meta")
def argument_hashes_cleared(s: SparkSession, d: str) -> DataFrame:
    return upkeep.without_argument_hashes(_meta(s, d)[0])


_GONE = "gone AS (SELECT DISTINCT file_path AS file FROM file_metadata WHERE NOT success)"


@query(f"""WITH {_GONE} SELECT 'symbols' AS table_name, count(CASE WHEN file IN (SELECT file FROM gone) THEN 1 END) AS n_deleted, count(CASE WHEN file IS NULL OR file NOT IN (SELECT file FROM gone WHERE file IS NOT NULL) THEN 1 END) AS n_kept FROM symbols
 UNION ALL SELECT 'call_sites', count(CASE WHEN file IN (SELECT file FROM gone) THEN 1 END), count(CASE WHEN file IS NULL OR file NOT IN (SELECT file FROM gone WHERE file IS NOT NULL) THEN 1 END) FROM call_sites""")
def deleted_by_file(s: SparkSession, d: str) -> DataFrame:
    """What goes from symbols and call sites with the files that failed to parse."""
    gone = table(s, d, "file_metadata").filter("NOT success").select("file_path")
    return upkeep.deleted_counts({n: table(s, d, n) for n in ("symbols", "call_sites")}, gone)


@query(f"""WITH {_GONE}, g AS (SELECT file FROM gone WHERE file IS NOT NULL) SELECT 'symbols' AS table_name, count(*) AS n FROM symbols WHERE file IS NULL OR file NOT IN (SELECT file FROM g) UNION ALL SELECT 'call_sites', count(*) FROM call_sites WHERE file IS NULL OR file NOT IN (SELECT file FROM g)
 UNION ALL SELECT 'file_metadata', count(*) FROM file_metadata WHERE file_path IS NULL OR file_path NOT IN (SELECT file FROM g)""")
def removed_files(s: SparkSession, d: str) -> DataFrame:
    """What three tables keep when those files go."""
    gone = table(s, d, "file_metadata").filter("NOT success").select(F.col("file_path").alias("file"))
    kept = upkeep.remove_files({"symbols": (table(s, d, "symbols"), "file"), "call_sites": (table(s, d, "call_sites"), "file"), "file_metadata": (table(s, d, "file_metadata"), "file_path")}, gone)
    parts = [t.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n, t in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {SYM} SELECT file, count(*) AS symbol_count FROM sym WHERE file IS NOT NULL GROUP BY 1")
def symbol_counts_per_file(s: SparkSession, d: str) -> DataFrame:
    return upkeep.symbol_counts(rel.symbols(s, d))


@query("SELECT count(CASE WHEN indexed_at >= TIMESTAMP '2024-01-01' - INTERVAL 90 DAY THEN 1 END) AS n_kept, count(CASE WHEN indexed_at IS NULL OR indexed_at < TIMESTAMP '2024-01-01' - INTERVAL 90 DAY THEN 1 END) AS n_removed FROM file_metadata WHERE NOT success")
def cleared_errors(s: SparkSession, d: str) -> DataFrame:
    from ..operators.store import cleared

    return cleared(table(s, d, "file_metadata").filter("NOT success").withColumn("at", F.col("indexed_at")), 90, "2024-01-01")


@query(f"""WITH {SYM}, {EDGES} SELECT 'no_usr' AS check_name, count(*) AS n, CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warning' END AS status FROM symbols WHERE usr IS NULL UNION ALL SELECT 'size', count(*), CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) > 1000000 THEN 'too many' ELSE 'ok' END FROM sym
 UNION ALL SELECT 'tokens', count(*), CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warning' END FROM sym WHERE NOT regexp_matches(name, '[A-Za-z0-9]') OR name IS NULL
 UNION ALL SELECT 'callers', count(*), CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warning' END FROM edges WHERE caller_usr NOT IN (SELECT usr FROM sym)""")
def health_report(s: SparkSession, d: str) -> DataFrame:
    sym = rel.symbols(s, d)
    return upkeep.health_report(table(s, d, "symbols"), sym, search.token_table(sym), rel.call_edges(s, d))


# --- increments -----------------------------------------------------------

#: Two snapshots of the include files: a tenth has changed, some are new, some gone; those that are included count as headers.
_FILES = f"""{INCLUDES}, files AS (SELECT DISTINCT f AS path, CAST(substr(f, 2, length(f) - 3) AS BIGINT) AS k, f IN (SELECT included_file FROM includes) AS is_header FROM (SELECT source_file AS f FROM includes UNION SELECT included_file FROM includes)),
 old AS (SELECT path, is_header, md5(path) AS hash FROM files WHERE k % 19 <> 0), new AS (SELECT path, is_header, md5(CASE WHEN k % 10 = 0 THEN path || '!' ELSE path END) AS hash FROM files WHERE k % 17 <> 0),
 chg AS (SELECT coalesce(o.path, n.path) AS path, coalesce(n.is_header, o.is_header) AS is_header, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'modified' END AS change FROM old o FULL JOIN new n ON o.path = n.path)"""


def _file_changes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    inc = rel.includes(s, d)
    heads = inc.select(F.col("included_file").alias("path")).distinct().withColumn("h", F.lit(True))
    every = inc.select(F.explode(F.array("source_file", "included_file")).alias("path")).distinct().join(heads, "path", "left").select("path", F.coalesce("h", F.lit(False)).alias("is_header"), F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("k"))
    old = every.filter("k % 19 <> 0").select("path", "is_header", F.md5("path").alias("hash"))
    new = every.filter("k % 17 <> 0").select("path", "is_header", F.md5(F.when(F.col("k") % 10 == 0, F.concat("path", F.lit("!"))).otherwise(F.col("path"))).alias("hash"))
    return upkeep.scanned_changes(old, new), inc


@query(f"WITH {_FILES} SELECT * FROM chg WHERE change IS NOT NULL")
def scanned_changes(s: SparkSession, d: str) -> DataFrame:
    return _file_changes(s, d)[0]


@query(f"""WITH RECURSIVE {_FILES}, args AS (SELECT DISTINCT source_file AS path FROM includes WHERE source_file LIKE 'f1%'), touched AS (SELECT path FROM chg WHERE is_header AND change IN ('modified', 'removed')),
 r AS (SELECT path AS node FROM touched UNION SELECT i.source_file FROM r JOIN includes i ON i.included_file = r.node), direct AS (SELECT node AS path FROM r WHERE node NOT IN (SELECT path FROM touched)),
 todo AS (SELECT path, 0 AS k FROM args UNION ALL SELECT path, 1 FROM direct UNION ALL SELECT path, 1 FROM chg WHERE is_header AND change = 'modified' UNION ALL SELECT path, 2 FROM chg WHERE NOT is_header AND change = 'modified' UNION ALL SELECT path, 3 FROM chg WHERE change = 'added'),
 g AS (SELECT path FROM chg WHERE change = 'removed') SELECT path, ['compile_arguments', 'header', 'source', 'new', 'removed'][min(k) + 1] AS reason FROM (SELECT * FROM todo WHERE path NOT IN (SELECT path FROM g) UNION ALL SELECT path, 4 FROM g) GROUP BY path""")
def incremental_plan(s: SparkSession, d: str) -> DataFrame:
    """Why each file has to be analysed again, the strongest reason."""
    changes, inc = _file_changes(s, d)
    return upkeep.incremental_plan(changes, inc, inc.filter("source_file LIKE 'f1%'").select(F.col("source_file").alias("path")).distinct())


@query(f"WITH {_FILES} SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'drop' ELSE 'refresh' END AS action FROM old o FULL JOIN new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.hash <> n.hash")
def refresh_files(s: SparkSession, d: str) -> DataFrame:
    changes, _ = _file_changes(s, d)
    return changes.select("path", F.when(F.col("change") == "removed", "drop").otherwise("refresh").alias("action"))


@query("""SELECT file_path AS header, CASE WHEN e IS NULL THEN 'in_progress' WHEN e THEN 'processed' ELSE 'unseen' END AS state, CASE WHEN e IS NULL OR e THEN h END AS hash FROM (SELECT file_path, arg_max_null(success, (coalesce(indexed_at, TIMESTAMP '1900-01-01'), record_id)) AS e, arg_max_null(file_hash, (coalesce(indexed_at, TIMESTAMP '1900-01-01'), record_id)) AS h
 FROM file_metadata WHERE file_path IS NOT NULL GROUP BY 1)""")
def header_states(s: SparkSession, d: str) -> DataFrame:
    """Where the log leaves each file: a delivery without a result is a claim, a failed one an invalidation."""
    m = table(s, d, "file_metadata").filter("file_path IS NOT NULL")
    event = F.when(F.col("success").isNull(), "claim").when(F.col("success"), "complete").otherwise("invalidate")
    return upkeep.header_states(m.select(F.col("file_path").alias("header"), event.alias("event"), F.col("file_hash").alias("hash"), F.struct("indexed_at", "record_id").alias("at")))


@query(f"""WITH {CC}, a AS (SELECT file, sha256(array_to_string(arguments, '|')) AS hash FROM (SELECT file, arg_min(arguments, command_id) AS arguments FROM cc WHERE arguments IS NOT NULL AND command_id % 2 = 0 GROUP BY 1)),
 b AS (SELECT file, sha256(array_to_string(arguments, '|')) AS hash FROM (SELECT file, arg_max(arguments, command_id) AS arguments FROM cc WHERE arguments IS NOT NULL GROUP BY 1))
 SELECT count(CASE WHEN a.file IS NULL THEN 1 END) AS n_new, count(CASE WHEN a.hash <> b.hash THEN 1 END) AS n_changed, count(CASE WHEN a.hash = b.hash THEN 1 END) AS n_same FROM b LEFT JOIN a USING (file)""")
def stored_hashes(s: SparkSession, d: str) -> DataFrame:
    t = _commands(s, d).withColumnRenamed("position", "command_id").filter("arguments IS NOT NULL")
    h = lambda df, pick: df.groupBy("file").agg(pick("arguments", "command_id").alias("a")).select("file", F.sha2(F.array_join("a", "|"), 256).alias("hash"))
    return upkeep.stored_hashes(h(t.filter("command_id % 2 = 0"), F.min_by), h(t, F.max_by))


@query("""WITH f AS (SELECT run_id, file_path, max(CASE WHEN coalesce(success, true) THEN 1 ELSE 0 END) AS ok, min(indexed_at) AS a, max(indexed_at) AS z FROM file_metadata GROUP BY 1, 2), r AS (SELECT run_id, count(*) AS n, sum(ok) AS ok, min(a) AS a, max(z) AS z FROM f GROUP BY 1)
 SELECT run_id, n AS n_files, CAST(ok AS BIGINT) AS n_done, CAST(n - ok AS BIGINT) AS n_failed, CASE WHEN n > 0 THEN round(100.0 * ok / n, 1) ELSE 0.0 END AS percent, CASE WHEN epoch_us(z) - epoch_us(a) > 0 THEN round(n / ((epoch_us(z) - epoch_us(a)) / 6e7), 4) END AS per_minute FROM r""")
def index_progress(s: SparkSession, d: str) -> DataFrame:
    return upkeep.progress(table(s, d, "file_metadata"))


@query("SELECT run_id, count(CASE WHEN NOT coalesce(success, true) THEN 1 END) AS n_errors, round(count(CASE WHEN NOT coalesce(success, true) THEN 1 END) / count(*), 6) AS share, round(count(CASE WHEN NOT coalesce(success, true) THEN 1 END) / (SELECT count(*) FROM file_metadata), 6) AS lifetime_share, count(CASE WHEN NOT coalesce(success, true) THEN 1 END) / count(*) >= 0.05 AS fall_back FROM file_metadata GROUP BY 1")
def error_triggers(s: SparkSession, d: str) -> DataFrame:
    return upkeep.error_triggers(table(s, d, "file_metadata"))


@query("SELECT file, command_id, command FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY command_id) AS r FROM compile_commands WHERE file IS NOT NULL) WHERE r = 1")
def first_commands(s: SparkSession, d: str) -> DataFrame:
    """The first command of each file."""
    t = table(s, d, "compile_commands").select("file", "directory", "command", "arguments", F.col("command_id").alias("position"))
    return tables.first_commands(t).select("file", F.col("position").alias("command_id"), "command")


@query(f"""WITH {CC}, u AS (SELECT command_id, unnest(arguments) AS v FROM cc WHERE len(arguments) > 0) SELECT v AS value, min(command_id) AS first_command FROM u WHERE starts_with(v, '-std=') OR starts_with(v, '-D') GROUP BY 1""")
def argument_values(s: SparkSession, d: str) -> DataFrame:
    """Every standard and definition in use, with the command that has it first."""
    return tables.ordered_values(_commands(s, d), ("-std=", "-D"))


@query(f"""WITH w AS (SELECT command_id, {WORDS_SQL} AS words FROM compile_commands) SELECT command_id, len(words) AS n, md5(array_to_string(words, chr(10))) AS words_md5 FROM w WHERE words IS NOT NULL""")
def command_arguments(s: SparkSession, d: str) -> DataFrame:
    """How many words every command text has, and their hash."""
    got = table(s, d, "compile_commands").select("command_id", command_words(F.col("command")).alias("words")).filter("words IS NOT NULL")
    return got.select("command_id", F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", "\n")).alias("words_md5"))


# --- telemetry ------------------------------------------------------------

_EXP = "exp AS (SELECT event_id AS seq, list_filter([event_type, CASE WHEN event_id % 2 = 0 THEN 'view' END, CASE WHEN event_id % 3 = 0 THEN 'click' END], lambda x: x IS NOT NULL) AS expected, list_filter([CASE WHEN event_id % 5 = 0 THEN 'view' END, event_type, CASE WHEN event_id % 7 = 0 THEN 'purchase' END], lambda x: x IS NOT NULL) AS called FROM events)"


def _expected(s: SparkSession, d: str) -> DataFrame:
    e, k = table(s, d, "events"), F.col("event_id")
    some = lambda *cs: F.array_compact(F.array(*cs))
    return e.select(k.alias("seq"), some(F.col("event_type"), F.when(k % 2 == 0, "view"), F.when(k % 3 == 0, "click")).alias("expected"), some(F.when(k % 5 == 0, "view"), F.col("event_type"), F.when(k % 7 == 0, "purchase")).alias("called"))


@query(f"""WITH {_EXP}, c AS (SELECT DISTINCT seq, unnest(called) AS tool FROM exp), e AS (SELECT DISTINCT seq, unnest(expected) AS tool FROM exp), m AS (SELECT coalesce(c.tool, e.tool) AS tool, c.seq AS c, e.seq AS e FROM c FULL JOIN e ON c.seq = e.seq AND c.tool = e.tool)
 SELECT tool, count(c) AS n_called, count(e) AS n_expected, CASE WHEN count(e) > 0 THEN round(count(CASE WHEN c IS NOT NULL AND e IS NOT NULL THEN 1 END) / count(e), 3) END AS match_rate FROM m GROUP BY 1""")
def tool_frequency(s: SparkSession, d: str) -> DataFrame:
    return telemetry.tool_frequency(_expected(s, d))


@query(f"""WITH {_EXP} SELECT seq, array_to_string(list_sort(list_distinct(list_filter(expected, lambda x: NOT list_contains(called, x)))), ',') AS missing, array_to_string(list_sort(list_distinct(list_filter(called, lambda x: NOT list_contains(expected, x)))), ',') AS extra FROM exp""")
def tool_differences(s: SparkSession, d: str) -> DataFrame:
    return telemetry.tool_differences(_expected(s, d))


@query(rf"""WITH {_REC}, one AS (SELECT seq, model_id, CASE WHEN contains(error, 'connection_error') THEN 'connection_error' WHEN contains(error, 'max_tokens') THEN 'max_tokens_exceeded' WHEN error IS NOT NULL THEN 'other_error' WHEN total_tool_calls = 0 THEN 'no_tool_calls' END AS label FROM ok),
 rest AS (SELECT ok.* FROM ok JOIN one USING (seq) WHERE label IS NULL), every AS (SELECT seq, model_id, label FROM one WHERE label IS NOT NULL UNION ALL SELECT seq, model_id, 'empty_pattern' FROM rest WHERE pattern = '' UNION ALL SELECT seq, model_id, 'signature_in_pattern' FROM rest WHERE regexp_matches(pattern, '\(.*\)|\bconst\b.*&|\b(void|bool|int)\b\s+\w+')
 UNION ALL SELECT seq, model_id, 'qualified_name_as_pattern' FROM rest WHERE regexp_full_match(pattern, '\w+(::\w+)+') UNION ALL SELECT seq, model_id, 'empty_results_no_retry' FROM rest WHERE counts[1] = 0 AND counts[2] = 0
 UNION ALL SELECT seq, model_id, 'wrong_regex' FROM rest WHERE (counts[1] = 0 OR counts[2] = 0) AND (starts_with(pattern, '^') OR ends_with(pattern, '$')))
 SELECT label, model_id, count(*) AS n, array_to_string(list_sort(min(seq, 3)), ',') AS examples FROM every GROUP BY 1, 2""")
def failure_examples(s: SparkSession, d: str) -> DataFrame:
    return telemetry.failure_examples(_records(s, d))


@query(f"""WITH {CALLS}, n AS (SELECT *, row_number() OVER w AS nth, CASE WHEN lag(tool) OVER w = tool THEN 0 ELSE 1 END AS new FROM calls WINDOW w AS (PARTITION BY session ORDER BY ts, call_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY nth) AS stretch FROM n)
 SELECT session, tool, arg_min(call_id, nth) AS first_call, count(*) AS n FROM g GROUP BY session, stretch, tool HAVING count(*) >= 4""")
def runaway_loops(s: SparkSession, d: str) -> DataFrame:
    return telemetry.runaway_loops(rel.tool_calls(s, d), 4)


@query(f"""WITH {CALLS}, t AS (SELECT max(epoch_us(ts)) AS now FROM calls) SELECT tool AS kind, CASE WHEN result_count = 0 THEN 'empty' ELSE 'data' END AS operation, count(*) AS n FROM calls, t WHERE tool = 'error' AND epoch_us(ts) > now - 86400000000 * 3 GROUP BY 1, 2""")
def error_summary(s: SparkSession, d: str) -> DataFrame:
    """Errors of the last three days of the log."""
    calls = rel.tool_calls(s, d)
    now = calls.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return telemetry.error_summary(calls, F.lit(now), 3 * 86_400)


@query(f"""WITH {_REC}, c AS (SELECT seq, pattern, CASE WHEN pattern = 'void f(int)' THEN 'signature_like' WHEN pattern = 'ns::Foo' THEN 'qualified_name' WHEN pattern = '^Foo' THEN 'regex' ELSE 'plain_name' END AS pattern_class FROM rec), {CALLS}
 SELECT c.seq AS call_id, calls.result_count = 0 AS is_empty, calls.result_count > 20 AS is_large, c.pattern_class FROM c JOIN calls ON calls.call_id = c.seq""")
def enriched_calls(s: SparkSession, d: str) -> DataFrame:
    calls = rel.tool_calls(s, d).join(_records(s, d).select(F.col("seq").alias("call_id"), "pattern"), "call_id")
    return telemetry.enriched(calls).select("call_id", "is_empty", "is_large", "pattern_class")


@query(f"WITH {SYM}, p AS (SELECT DISTINCT upper(name) AS pattern FROM sym WHERE name IS NOT NULL), n AS (SELECT DISTINCT name, name_lc FROM sym WHERE name IS NOT NULL) SELECT pattern, array_to_string(list_sort(min(name, 3)), ',') AS names FROM p JOIN n ON n.name_lc = lower(p.pattern) GROUP BY 1")
def alternative_names(s: SparkSession, d: str) -> DataFrame:
    sym = rel.symbols(s, d).filter("name IS NOT NULL")
    return telemetry.alternative_names(sym.select(F.upper("name").alias("pattern")).distinct(), sym)


@query(f"""WITH {_REC}, e AS (SELECT seq, category, CASE WHEN contains(error, 'connection_error') THEN 'connection_error' WHEN contains(error, 'max_tokens') THEN 'max_tokens_exceeded' WHEN total_tool_calls = 0 THEN 'no_tool_calls' END AS label FROM ok) SELECT label, category, count(*) AS n, min(seq) AS first_seq FROM e WHERE label IS NOT NULL GROUP BY 1, 2""")
def compact_report(s: SparkSession, d: str) -> DataFrame:
    """Calls that failed outright, by label and category."""
    r = _records(s, d)
    got = telemetry.failure_labels(r).filter("label IN ('connection_error', 'max_tokens_exceeded', 'no_tool_calls')").join(r.select("seq", "category"), "seq")
    return telemetry.compact_report(got)


@query("""SELECT event_id AS response_id, CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n_calls, CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_type || ',view' END AS tools, CASE WHEN event_id % 37 = 0 THEN 'max_tokens' END AS error, 'text ' || event_id AS text FROM events""")
def response_records(s: SparkSession, d: str) -> DataFrame:
    """Model responses read from JSON made of the events."""
    e, k = table(s, d, "events"), F.col("event_id")
    item = lambda kind, name, text: F.struct(F.lit(kind).alias("type"), name.alias("name"), text.alias("text"))
    none = F.lit(None).cast("string")
    calls = F.array_compact(F.array(item("function_call", F.col("event_type"), none), item("message", none, F.concat(F.lit("text "), k)), F.when(k % 3 != 0, item("function_call", F.lit("view"), none))))
    body = F.to_json(F.struct(calls.alias("output"), F.when(k % 37 == 0, "max_tokens").otherwise("stop").alias("stop_reason")))
    return telemetry.response_records(e.select(k.alias("response_id"), body.alias("body")))
