"""Queries of the sources: compile databases, include lines, source texts, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.arguments import arguments_hash, command_words, project_hash
from ..operators.store import Table
from ..session import scratch_path, table
from ..sources import extract, tables
from ..streaming import streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _put(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


#: The words of a command as a POSIX shell makes them (JSON arrays as they are, semicolons as blanks), in DuckDB.
WORDS_SQL = r"""CASE WHEN command IS NULL OR NOT regexp_matches(command, '\S') THEN NULL WHEN json_valid(command) AND json_type(command) = 'ARRAY' THEN CAST(from_json(command, '["VARCHAR"]') AS VARCHAR[])
 ELSE list_transform(regexp_extract_all(regexp_replace(command, '\\\r?\n', '', 'g'), '(?:[^\s"''\\;]|\\(?s:.)|"(?:[^"\\]|\\(?s:.))*"|''[^'']*'')+'), lambda w: array_to_string(list_transform(regexp_extract_all(w, '"(?:[^"\\]|\\(?s:.))*"|''[^'']*''|(?:[^"''\\]|\\(?s:.))+'),
  lambda p: CASE WHEN p[1] = '"' THEN regexp_replace(p[2:-2], '\\(["\\$`])', '\1', 'g') WHEN p[1] = '''' THEN p[2:-2] ELSE regexp_replace(p, '\\((?s:.))', '\1', 'g') END), '')) END"""
#: Every entry with its arguments, whichever way it states them.
CC = f"cc AS (SELECT * EXCLUDE (arguments), coalesce(arguments, {WORDS_SQL}) AS arguments FROM compile_commands)"


def _commands(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "compile_commands")
    return t.select("file", "directory", F.coalesce("arguments", command_words(F.col("command"))).alias("arguments"), F.col("command_id").alias("position"))


@_put()
def compile_arguments(s: SparkSession, d: str) -> DataFrame:
    """The cleaned arguments of each file's last command."""
    rules = [{"type": "prefix_match", "patterns": ["-Wl,", "-march="]}, {"type": "exact_match", "patterns": ["-g"]}, {"type": "flag_with_optional_value", "pattern": "-include"}]
    t = table(s, d, "compile_commands").select("file", "directory", "command", "arguments", F.col("command_id").alias("position"))
    return tables.latest_arguments(t, rules, ("-std=c++17",))


@_put(f"""WITH {CC}, a AS (SELECT file, arguments FROM cc WHERE len(arguments) > 0), u AS (SELECT unnest(arguments) AS v, unnest(list_concat(arguments[2:], [NULL])) AS nxt FROM a)
 SELECT (SELECT count(*) FROM a) AS n_entries, (SELECT count(DISTINCT file) FROM a) AS n_files, count(DISTINCT CASE WHEN starts_with(v, '-std=') THEN v END) AS n_std, count(DISTINCT CASE WHEN v = '-isystem' THEN nxt END) AS n_system FROM u""")
def argument_profile(s: SparkSession, d: str) -> DataFrame:
    return tables.argument_profile(_commands(s, d))


@_put("SELECT command_id AS position, file FROM compile_commands WHERE starts_with(file, '/srv/build/atlas/') OR starts_with(file, '/srv/build/cinder/')")
def commands_under(s: SparkSession, d: str) -> DataFrame:
    return tables.under(_commands(s, d), ["/srv/build/atlas", "/srv/build/cinder/"]).select("position", "file")


@_put(f"""WITH {CC}, u AS (SELECT file, unnest(arguments) AS v, unnest(list_concat(arguments[2:], [NULL])) AS nxt FROM cc WHERE len(arguments) > 0),
 p AS (SELECT file, CASE WHEN v IN ('-I', '-isystem') THEN nxt WHEN regexp_matches(v, '^(-I|-isystem).+') THEN regexp_replace(v, '^(-isystem|-I)', '') END AS directory FROM u)
 SELECT directory, count(DISTINCT file) AS n_files FROM p WHERE directory IS NOT NULL AND directory NOT IN (SELECT DISTINCT directory FROM compile_commands WHERE directory IS NOT NULL) GROUP BY 1""")
def include_audit(s: SparkSession, d: str) -> DataFrame:
    return tables.include_audit(_commands(s, d), _commands(s, d).filter("directory IS NOT NULL"))


@_put(f"WITH {CC} SELECT command_id, sha256(array_to_string(arguments, '|')) AS args_hash, left(sha256(directory || '|' || file), 16) AS project_hash FROM cc WHERE arguments IS NOT NULL AND directory IS NOT NULL AND file IS NOT NULL")
def argument_hashes(s: SparkSession, d: str) -> DataFrame:
    t = _commands(s, d).filter("arguments IS NOT NULL AND directory IS NOT NULL AND file IS NOT NULL")
    return t.select(F.col("position").alias("command_id"), arguments_hash(F.col("arguments")).alias("args_hash"), project_hash(F.col("directory"), F.col("file")).alias("project_hash"))


@_put(r"""SELECT DISTINCT doc_id AS file, unnest(regexp_extract_all(text, '(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', 1)) AS included FROM documents WHERE text IS NOT NULL""")
def include_lines(s: SparkSession, d: str) -> DataFrame:
    return tables.include_lines(table(s, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")))


@_put()
def source_facts(s: SparkSession, d: str) -> DataFrame:
    """Classes, functions, aliases and calls of all C++ among the documents: source texts, and the fenced parts of others."""
    texts = table(s, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("file"), extract.code_in("text").alias("content"))
    return extract.facts(texts.filter("content IS NOT NULL"))


@_put("SELECT DISTINCT file, starts_with(file, '/srv/build/') AND len(list_filter(string_split(substr(file, 12), '/'), lambda x: x IN ('generated', 'third_party'))) = 0 AS is_project FROM call_sites WHERE file IS NOT NULL")
def project_files(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "call_sites").filter("file IS NOT NULL").select("file").distinct()
    return t.select("file", naming.project_file(F.col("file"), "/srv/build", ("generated", "third_party")).alias("is_project"))


@_put()
def doc_briefs(s: SparkSession, d: str) -> DataFrame:
    """Brief and shortened documentation of every documented symbol row."""
    t = table(s, d, "symbols").filter(F.col("doc_comment").rlike(r"\S"))
    return t.select("usr", naming.brief_of(F.col("doc_comment")).alias("brief"), naming.doc_text(F.col("doc_comment")).alias("doc"))


@_put("SELECT count(DISTINCT usr) AS n FROM symbols")
def stream_merge(s: SparkSession, d: str) -> DataFrame:
    """Symbols merged as a stream; as many as there are usrs."""
    base = scratch_path(s, "stream")
    got = streams.merge_symbols(s, streams.follow(s, d, "symbols").filter("usr IS NOT NULL"), Table(s, f"{base}/table"), f"{base}/checkpoint")
    return got.agg(F.count(F.lit(1)).alias("n"))


@_put("""SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS start, count(*) AS n_calls, count(CASE WHEN event_type = 'error' THEN 1 END) AS n_errors FROM events
 GROUP BY time_bucket(INTERVAL '1 day', ts) HAVING time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 2 DAY""")
def stream_error_rate(s: SparkSession, d: str) -> DataFrame:
    """Windows of the event stream that the watermark has closed."""
    base = scratch_path(s, "rates")
    out = Table(s, f"{base}/table")

    def keep(batch: DataFrame, _: int) -> None:
        rows = batch.select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "n_calls", "n_errors")
        out.commit(rows if out._pointer() is None else out.read().unionByName(rows))

    streams.run_once(streams.error_rate(streams.follow(s, d, "events")), keep, f"{base}/checkpoint")
    return out.read()


@_put()
def stream_header_claims(s: SparkSession, d: str) -> DataFrame:
    """Deliveries of the file log that are the first of their file and state."""
    base = scratch_path(s, "claims")
    out = Table(s, f"{base}/table")

    def keep(batch: DataFrame, _: int) -> None:
        rows = batch.select("record_id", "file_path", "file_hash")
        out.commit(rows if out._pointer() is None else out.read().unionByName(rows))

    streams.run_once(streams.claim_headers(streams.follow(s, d, "file_metadata").filter("file_hash IS NOT NULL")), keep, f"{base}/checkpoint")
    return out.read()
