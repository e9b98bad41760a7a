"""Snapshots compared: changed files, changed compile arguments, what to analyse again, what to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import levels


def change_set(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(key, change): added, removed or modified; unreadable new values (null) count as modified."""
    a, b = old.select(key, F.col(value).alias("__a"), F.lit(True).alias("__old")), new.select(key, F.col(value).alias("__b"), F.lit(True).alias("__new"))
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__b").isNull() | ~F.col("__a").eqNullSafe(F.col("__b")), "modified")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).filter("change IS NOT NULL")


def argument_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change) between two maps of compile argument hashes; the order of arguments counts in the hash."""
    return change_set(old.withColumnRenamed("file", "path"), new.withColumnRenamed("file", "path")).withColumnRenamed("path", "file")


def reanalysis_set(changes: DataFrame, includes: DataFrame) -> DataFrame:
    """(path): added and modified files and everything that includes a modified or removed one, however far."""
    moved = changes.filter("change <> 'added'").select(F.col("path").alias("node"))
    dependents = levels(includes, moved, "included_file", "source_file").filter("depth > 0").select(F.col("node").alias("path"))
    return changes.filter("change <> 'removed'").select("path").unionByName(dependents).distinct()


def claimed_headers(deliveries: DataFrame) -> DataFrame:
    """(header, hash, claimed_by): the first source to deliver each header in each state processes it."""
    return deliveries.groupBy("header", "hash").agg(F.min_by("source", F.struct("at", "source")).alias("claimed_by"))


def valid_cache(cached: DataFrame, current: DataFrame) -> DataFrame:
    """(path, valid): a cached file is valid while both its hashes are what they are now (null equals null)."""
    now = current.select("path", F.col("hash").alias("h"), F.col("args_hash").alias("a"), F.lit(True).alias("there"))
    return cached.join(now, "path", "left").select("path", F.coalesce(F.col("there") & F.col("hash").eqNullSafe(F.col("h")) & F.col("args_hash").eqNullSafe(F.col("a")), F.lit(False)).alias("valid"))


def retry_counts(log: DataFrame, max_retries: int = 2) -> DataFrame:
    """(file_path, failures, retry): failures since the last success, and whether to try again."""
    last_ok = log.groupBy("file_path").agg(F.max(F.when(F.coalesce("success", F.lit(True)), F.struct("indexed_at", "record_id"))).alias("ok"))
    failed = log.filter(~F.coalesce("success", F.lit(True))).select("file_path", F.struct("indexed_at", "record_id").alias("at"))
    n = failed.join(last_ok, "file_path").filter(F.col("ok").isNull() | (F.col("at") > F.col("ok"))).groupBy("file_path").agg(F.count(F.lit(1)).alias("failures"))
    return n.select("file_path", "failures", (F.col("failures") <= max_retries).alias("retry"))
