"""Keyed writes, deletes, statistics and checks over the index's tables.

Tables are immutable folders: an upsert is a union and a keyed aggregate, a delete
an anti-join, and ``commit`` swaps the new version in by a pointer file.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _fs, remove_path
from .changes import _names, _read_text, _write_text


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, per key the one with the greatest ``order``; ``new`` wins ties."""
    cols = old.columns
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*cols).withColumn("__new", F.lit(1)))
    rest = [c for c in cols if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "__new")).alias("s")).select(*keys, "s.*").select(*cols)


def delete_where_in(rows: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose ``columns`` is among the values of ``gone`` (one column)."""
    out, name = rows, gone.columns[0]
    for c in columns:
        out = out.join(gone.select(F.col(name).alias(c)).distinct(), c, "left_anti")
    return out.select(*rows.columns)


def replace_group(rows: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``rows`` with all groups that ``fresh`` brings replaced by its distinct rows."""
    return delete_where_in(rows, fresh.select(key), key).unionByName(fresh.select(*rows.columns).distinct())


class Table:
    """A versioned table in a folder; readers see the last committed version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointers(self) -> list[int]:
        return sorted(int(n.split(".")[1]) for n in _names(self.spark, self.path) if n.startswith("_current.") and n.endswith(".json"))

    def _pointer(self) -> dict | None:
        """The latest pointer; each commit writes one under a new number, so there is one at any time."""
        numbers = self._pointers()
        return json.loads(_read_text(self.spark, f"{self.path}/_current.{numbers[-1]}.json")) if numbers else None

    def _point(self, told: dict) -> None:
        numbers = self._pointers()
        _write_text(self.spark, f"{self.path}/_current.{numbers[-1] + 1 if numbers else 1}.json", json.dumps(told))
        for n in numbers[:-1]:
            remove_path(self.spark, f"{self.path}/_current.{n}.json")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._pointer()['version']}")

    def commit(self, df: DataFrame, keep: int = 2) -> None:
        """Write a new version, then point to it; versions beyond ``keep`` go."""
        now, version = self._pointer() or {"versions": []}, f"v-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.path}/{version}")
        versions = [*now["versions"], version]
        self._point({"version": version, "versions": versions[-keep:]})
        for old in versions[:-keep]:
            remove_path(self.spark, f"{self.path}/{old}")

    def clear(self) -> None:
        """A new version without rows."""
        self.commit(self.read().limit(0))

    def versions(self) -> list[str]:
        return (self._pointer() or {"versions": []})["versions"]

    def at(self, version: str) -> DataFrame:
        """An older version that is still kept: what a reader that began before the last commit goes on with."""
        return self.spark.read.parquet(f"{self.path}/{version}")

    def backup(self, path: str) -> None:
        """Copy the current version to ``path``."""
        self.read().write.mode("errorifexists").parquet(path)

    def repair(self) -> bool:
        """Go back to the newest version that can be read whole; False if there is none."""
        told = self._pointer() or {"versions": []}
        for k in range(len(told["versions"]), 0, -1):
            try:
                self.at(told["versions"][k - 1]).write.format("noop").mode("overwrite").save()
            except Exception:  # a file is gone or broken: the version before may be whole
                continue
            if k < len(told["versions"]):
                self._point({"version": told["versions"][k - 1], "versions": told["versions"][:k]})
            return True
        return False

    def restore(self) -> None:
        """Back to the version before."""
        now = self._pointer()
        versions = now["versions"][:-1]
        if versions:
            self._point({"version": versions[-1], "versions": versions})


# --- statistics and checks ------------------------------------------------

def symbol_stats(symbols: DataFrame) -> DataFrame:
    """(kind, n, n_project, n_files) by kind."""
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_project"), 1)).alias("n_project"), F.countDistinct("file").alias("n_files"))


def file_stats(counts: DataFrame, value: str = "symbol_count") -> DataFrame:
    """One row: files, sum, average (2 digits) and maximum."""
    return counts.agg(F.count(F.lit(1)).alias("n_files"), F.sum(value).alias("total"), F.round(F.avg(value), 2).alias("average"), F.max(value).alias("most"))


def top_files(symbols: DataFrame, k: int = 10) -> DataFrame:
    return symbols.filter("file IS NOT NULL").groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").limit(k)


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def integrity(rows: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(check_name, n_bad): repeated keys, calls without a caller, symbols without a file, spans that end before they start."""
    repeated = rows.groupBy("usr").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.lit("repeated_usr").alias("check_name"), F.count(F.lit(1)).alias("n_bad"))
    orphans = edges.join(symbols.select(F.col("usr").alias("caller_usr")), "caller_usr", "left_anti").agg(F.lit("unknown_caller").alias("check_name"), F.count(F.lit(1)).alias("n_bad"))
    bad = lambda name, cond: symbols.filter(cond).agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("n_bad"))
    return repeated.unionByName(orphans).unionByName(bad("no_file", "file IS NULL")).unionByName(bad("bad_span", "end_line < start_line"))


def health(symbols: DataFrame, many: int = 1_000_000) -> DataFrame:
    n = symbols.agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", F.when(F.col("n") == 0, "empty").when(F.col("n") > many, "too many").otherwise("ok").alias("status"))


def error_summary(errors: DataFrame) -> DataFrame:
    """(error_type, n_errors, n_files, last_at) of logged parse errors."""
    return errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("n_errors"), F.countDistinct("file_path").alias("n_files"), F.max("at").alias("last_at"))


def recent_errors(errors: DataFrame, k: int = 10) -> DataFrame:
    return errors.orderBy(F.desc("at"), F.desc("record_id")).limit(k)


def older_than(errors: DataFrame, days: int, now: str) -> DataFrame:
    """Errors to keep: none older than ``days`` before ``now``."""
    return errors.filter(F.col("at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def cleared(errors: DataFrame, days: int, now: str) -> DataFrame:
    """One row (n_kept, n_removed) of what ``older_than`` leaves of a log; errors without a time go."""
    keep = F.coalesce(F.col("at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    return errors.agg(F.count(F.when(keep, 1)).alias("n_kept"), F.count(F.when(~keep, 1)).alias("n_removed"))


def maintenance_plan(size_mb: float, waste_mb: float, n_files: int, least_mb: float = 100, least_waste_mb: float = 10) -> list[str]:
    """What upkeep a table needs: statistics always, a rewrite when it is large and wasteful or in many small files."""
    steps = ["analyze"]
    if size_mb >= least_mb and waste_mb >= least_waste_mb:
        steps.append("vacuum")
    if n_files > 1 and size_mb / n_files < 16:
        steps.append("compact")
    return steps
