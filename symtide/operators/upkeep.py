"""Upkeep of an index: file caches, argument hashes, incremental plans, header states, progress, policies and health."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _fs, path_exists
from .graphs import levels
from .store import delete_where_in, replace_group, upsert

# --- writes by file -------------------------------------------------------


def with_argument_hashes(metadata: DataFrame, hashes: DataFrame) -> DataFrame:
    """``metadata`` (path, ..., args_hash) with the hashes of ``hashes`` (path, args_hash): known paths are updated, others added."""
    new = hashes.select("path", F.col("args_hash").alias("__a"), F.lit(True).alias("__there"))
    met = metadata.join(new, "path", "full_outer")
    return met.withColumn("args_hash", F.when(F.col("__there"), F.col("__a")).otherwise(F.col("args_hash"))).drop("__a", "__there").select(*metadata.columns)


def without_argument_hashes(metadata: DataFrame) -> DataFrame:
    return metadata.withColumn("args_hash", F.lit(None).cast("string"))


def deleted_counts(tables: dict[str, DataFrame], gone: DataFrame, column: str = "file") -> DataFrame:
    """(table_name, n_deleted, n_kept) of deleting the rows of ``gone`` (one column) from each table."""
    keys = gone.select(F.col(gone.columns[0]).alias("__g"), F.lit(True).alias("__hit")).distinct()
    one = lambda name, t: t.select(F.col(column).alias("__g")).join(keys, "__g", "left").agg(F.lit(name).alias("table_name"), F.count(F.when(F.col("__hit"), 1)).alias("n_deleted"), F.count(F.when(F.col("__hit").isNull(), 1)).alias("n_kept"))
    return reduce(DataFrame.unionByName, (one(n, t) for n, t in tables.items()))


def remove_files(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table (rows, file column) without the files of ``gone`` (one column)."""
    name = gone.columns[0]
    return {k: delete_where_in(rows, gone.select(F.col(name).alias(c)), c) for k, (rows, c) in tables.items()}


def save_file(symbols: DataFrame, metadata: DataFrame, fresh: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The symbols with those of the files of ``info`` (path, at, success, ...) replaced by ``fresh``, and the metadata with their rows.

    A file that failed keeps a metadata row as well, and no symbols.
    """
    kept = delete_where_in(symbols, info.select(F.col("path").alias("file")), "file")
    return kept.unionByName(fresh.select(*symbols.columns)), upsert(metadata, info, ["path"], "at")


def merge_worker_result(symbols: DataFrame, sites: DataFrame, headers: DataFrame, result: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a worker found in some files takes the place of what was known of them: 'symbols', 'sites' by file, 'headers' by (header, hash)."""
    return {
        "symbols": replace_group(symbols, result["symbols"], "file"),
        "sites": replace_group(sites, result["sites"], "file"),
        "headers": headers.unionByName(result["headers"].select(*headers.columns)).dropDuplicates(["header", "hash"]),
    }


def symbol_counts(symbols: DataFrame) -> DataFrame:
    """(file, symbol_count): what a bulk save notes of every file."""
    return symbols.filter("file IS NOT NULL").groupBy("file").agg(F.count(F.lit(1)).alias("symbol_count"))


def cache_problems(stored: dict, now: dict, keys: tuple[str, ...] = ("include_dependencies", "config_path", "config_mtime", "compile_db_path", "compile_db_mtime", "version")) -> list[str]:
    """Which of the noted circumstances of a cache differ from those of now; a cache with any of them is not to be used."""
    return [k for k in keys if stored.get(k) != now.get(k)]


# --- what to do after changes ---------------------------------------------


def scanned_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, is_header, change) between two snapshots (path, hash, is_header); an unreadable file (null hash) counts as modified."""
    a = old.select("path", F.col("hash").alias("a"), F.col("is_header").alias("ah"), F.lit(True).alias("o"))
    b = new.select("path", F.col("hash").alias("b"), F.col("is_header").alias("bh"), F.lit(True).alias("n"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("b").isNull() | ~F.col("a").eqNullSafe(F.col("b")), "modified")
    return a.join(b, "path", "full_outer").select("path", F.coalesce("bh", "ah").alias("is_header"), kind.alias("change")).filter("change IS NOT NULL")


def compile_database_changed(before: str | None, now: str | None) -> bool:
    """Hashes of the compile database; one that has vanished counts as changed."""
    return before != now


#: Reasons to analyse a file again, the strongest first.
REASONS = ("compile_arguments", "header", "source", "new", "removed")


def incremental_plan(changes: DataFrame, includes: DataFrame, arguments: DataFrame) -> DataFrame:
    """(path, reason): every file once with its strongest reason (see REASONS).

    ``changes``: path, is_header, change; ``arguments``: files whose compile arguments are new or different. A changed or removed header
    brings in all that includes it, however far; a removed file is only removed.
    """
    step = lambda df, k: df.select("path", F.lit(k).alias("k"))
    touched = changes.filter("is_header AND change IN ('modified', 'removed')").select(F.col("path").alias("node"))
    below = levels(includes, touched, "included_file", "source_file").filter("depth > 0").select(F.col("node").alias("path"))
    gone = changes.filter("change = 'removed'").select("path")
    parts = [step(arguments.select("path"), 0), step(below, 1), step(changes.filter("is_header AND change = 'modified'"), 1), step(changes.filter("NOT is_header AND change = 'modified'"), 2), step(changes.filter("change = 'added'"), 3)]
    todo = reduce(DataFrame.unionByName, parts).join(gone, "path", "left_anti").unionByName(step(gone, 4))
    best = todo.groupBy("path").agg(F.min("k").alias("k"))
    return best.select("path", F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("k") + 1).alias("reason"))


def refresh_files(cached: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, action) at start: 'drop' what exists no more, 'refresh' what changed or is new."""
    c, e = cached.select("path", F.col("hash").alias("a"), F.lit(True).alias("c")), existing.select("path", F.col("hash").alias("b"), F.lit(True).alias("e"))
    act = F.when(F.col("e").isNull(), "drop").when(F.col("c").isNull() | ~F.col("a").eqNullSafe(F.col("b")), "refresh")
    return c.join(e, "path", "full_outer").select("path", act.alias("action")).filter("action IS NOT NULL")


def header_states(events: DataFrame) -> DataFrame:
    """(header, state, hash): what the last of a header's events (header, event, hash, at) makes of it.

    claim: in_progress; complete: processed; invalidate: unseen.
    """
    last = events.groupBy("header").agg(F.max_by(F.struct("event", "hash"), "at").alias("s"))
    state = F.when(F.col("s.event") == "claim", "in_progress").when(F.col("s.event") == "complete", "processed").otherwise("unseen")
    return last.select("header", state.alias("state"), F.when(state != "unseen", F.col("s.hash")).alias("hash"))


def stored_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(n_new, n_changed, n_same) of the argument hashes (file, hash) that are written over older ones."""
    met = new.join(old.select("file", F.col("hash").alias("o"), F.lit(True).alias("t")), "file", "left")
    n = lambda c: F.count(F.when(c, 1))
    return met.agg(n(F.col("t").isNull()).alias("n_new"), n(F.col("t") & ~F.col("o").eqNullSafe(F.col("hash"))).alias("n_changed"), n(F.col("t") & F.col("o").eqNullSafe(F.col("hash"))).alias("n_same"))


# --- progress, states, health ---------------------------------------------


def percent(done: Column, total: Column) -> Column:
    """Share in percent with one digit; 0 of nothing."""
    return F.when(total > 0, F.round(100.0 * done / total, 1)).otherwise(0.0)


def progress(deliveries: DataFrame, group: str = "run_id") -> DataFrame:
    """(group, n_files, n_done, n_failed, percent, per_minute): how far each run came; files by minute between its first and last delivery."""
    files = deliveries.groupBy(group, "file_path").agg(F.max(F.coalesce("success", F.lit(True)).cast("int")).alias("ok"), F.min("indexed_at").alias("first"), F.max("indexed_at").alias("last"))
    got = files.groupBy(group).agg(F.count(F.lit(1)).alias("n_files"), F.sum("ok").alias("n_done"), F.min("first").alias("first"), F.max("last").alias("last"))
    minutes = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 6e7
    rate = F.when(minutes > 0, F.round(F.col("n_files") / minutes, 4))
    return got.select(group, "n_files", "n_done", (F.col("n_files") - F.col("n_done")).alias("n_failed"), percent(F.col("n_done"), F.col("n_files")).alias("percent"), rate.alias("per_minute"))


def should_report(done: int, seconds: float, tty: bool = False) -> bool:
    """Every fifth file or after two seconds on a terminal, else every fiftieth or after five (fixed values)."""
    every, wait = (5, 2.0) if tty else (50, 5.0)
    return done % every == 0 or seconds >= wait


#: What may follow what in the life of a project.
NEXT = {"uninitialized": {"initializing"}, "initializing": {"indexing", "error"}, "indexing": {"indexed", "error"}, "indexed": {"refreshing", "indexing", "error"}, "refreshing": {"indexed", "error"}, "error": {"initializing", "indexing"}}


class ProjectState:
    """The state of a project and its progress, kept as a small JSON file where ``path`` is given."""

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self.spark, self.path, self.state, self.done, self.total = spark, path, "uninitialized", 0, 0

    def to(self, state: str) -> "ProjectState":
        if state not in NEXT[self.state]:
            raise ValueError(f"{state} cannot follow {self.state}")
        self.state = state
        return self

    def status(self) -> dict:
        share = round(100.0 * self.done / self.total, 1) if self.total else 0.0
        return {"state": self.state, "ready": self.state in ("indexed", "refreshing"), "partial": self.state in ("indexing", "refreshing"), "done": self.done, "total": self.total, "percent": share}

    def save(self) -> None:
        from .changes import _names, _write_text

        n = 1 + max([int(x.split(".")[1]) for x in _names(self.spark, self.path) if x.startswith("progress.") and x.endswith(".json")], default=0)
        _write_text(self.spark, f"{self.path}/progress.{n}.json", json.dumps(self.status()))

    def load(self) -> dict | None:
        from .changes import _names, _read_text

        n = max([int(x.split(".")[1]) for x in _names(self.spark, self.path) if x.startswith("progress.") and x.endswith(".json")], default=0)
        return json.loads(_read_text(self.spark, f"{self.path}/progress.{n}.json")) if n else None


def under_policy(policy: str, state: ProjectState, run: Callable[[], DataFrame], wait: Callable[[], bool] | None = None) -> tuple[DataFrame | None, str]:
    """A query while an index is being built: (rows, note).

    allow_partial reads the last committed version and says so; block asks ``wait`` whether it is ready in time; reject gives no rows.
    """
    now = state.status()
    if now["ready"] and not now["partial"]:
        return run(), ""
    if policy == "reject":
        return None, f"index is {now['state']}"
    if policy == "block":
        return (run(), "") if wait is not None and wait() else (None, "timed out")
    if policy != "allow_partial":
        raise ValueError(f"unknown policy {policy!r}")
    return run(), f"partial: {now['done']} of {now['total']} files, {now['percent']} percent"


def health_report(rows: DataFrame, symbols: DataFrame, tokens: DataFrame, edges: DataFrame, large: int = 1_000_000) -> DataFrame:
    """(check_name, n, status): rows without a usr, how many symbols, symbols whose name has no token, calls of callers nobody knows."""
    one = lambda name, df, status: df.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("n")).withColumn("status", status)
    zero = F.when(F.col("n") == 0, "ok").otherwise("warning")
    size = F.when(F.col("n") == 0, "empty").when(F.col("n") > large, "too many").otherwise("ok")
    lost = symbols.join(tokens.select("usr").distinct(), "usr", "left_anti")
    orphans = edges.join(symbols.select(F.col("usr").alias("caller_usr")), "caller_usr", "left_anti")
    parts = [one("no_usr", rows.filter("usr IS NULL"), zero), one("size", symbols, size), one("tokens", lost, zero), one("callers", orphans, zero)]
    return reduce(DataFrame.unionByName, parts)


def timings(checks: dict[str, Callable[[], DataFrame]]) -> dict[str, float]:
    """Seconds that each of some look-ups takes, for a report on how an index performs."""
    import time

    out = {}
    for name, run in checks.items():
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        out[name] = round(time.perf_counter() - began, 4)
    return out


def rotate(spark: SparkSession, path: str, max_bytes: int = 10 * 1024 * 1024) -> bool:
    """Move a log of more than ``max_bytes`` aside to ``path.1``, over an older one; whether it did."""
    if not path_exists(spark, path):
        return False
    fs, p = _fs(spark, path)
    if fs.getContentSummary(p).getLength() <= max_bytes:
        return False
    old = _fs(spark, path + ".1")[1]
    fs.delete(old, True)
    return bool(fs.rename(p, old))


# --- diagnostics ----------------------------------------------------------


def split_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """``diagnostics`` (severity, in_system_header, ...) with ``level``: errors from severity 3 on, but in system headers only warnings."""
    bad, system = F.col("severity") >= 3, F.coalesce("in_system_header", F.lit(False))
    return diagnostics.withColumn("level", F.when(bad & ~system, "error").when((F.col("severity") == 2) | bad, "warning").otherwise("note"))


def diagnostics_text(messages: Column, most: int = 5) -> Column:
    """The first messages, one to a line, and how many more there are."""
    head = F.array_join(F.slice(messages, F.lit(1), F.least(F.size(messages), F.lit(most))), "\n")
    return F.when(F.size(messages) > most, F.concat(head, F.lit("\n... and "), (F.size(messages) - most).cast("string"), F.lit(" more"))).otherwise(head)


def location_columns(declared_file: Column, declared_line: Column, defined_file: Column, defined_line: Column) -> Column:
    """(file, line, header_file, header_line): the header only where a symbol is declared in another file than it is defined in."""
    apart = F.coalesce((declared_file != defined_file), F.lit(False))
    return F.struct(F.coalesce(defined_file, declared_file).alias("file"), F.coalesce(defined_line, declared_line).alias("line"), F.when(apart, declared_file).alias("header_file"), F.when(apart, declared_line).alias("header_line"))


# --- hints ----------------------------------------------------------------


def hints(kind: str, n: int = 0) -> list[str]:
    """What to try when calls or paths are not found."""
    if n:
        return []
    return {
        "call_sites": ["the function may only be called through a pointer or a template", "search with external libraries included"],
        "call_path": ["raise max_depth", "ask for the callers of the target first", "the path may go through a virtual call"],
    }.get(kind, [])


def error_triggers(deliveries: DataFrame, limit: float = 0.05) -> DataFrame:
    """(run_id, n_errors, share, lifetime_share, fall_back): failed deliveries of each run, and whether they are so many that a fallback should take over."""
    n = deliveries.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.coalesce("success", F.lit(True)), 1)).alias("n_errors"))
    total = F.lit(max(1, deliveries.count()))
    return n.select("run_id", "n_errors", F.round(F.col("n_errors") / F.col("n"), 6).alias("share"), F.round(F.col("n_errors") / total, 6).alias("lifetime_share"), (F.col("n_errors") / F.col("n") >= limit).alias("fall_back"))
