"""Processing only new or changed records, run by run.

Method: log-based change capture with per-partition offsets, a write-ahead batch
plan that is replayed after a failure, and a sink that deduplicates by key and
offset. The log is split into ``partitions`` by key; an offset is a place in the order
of arrival (record_id), so what arrives late about an old run still lies ahead of it. A
batch plan names for each partition the offsets it reads from and to and which runs
had succeeded, and is written before any work starts. A batch without its commit
mark is replayed from its plan and overwrites its own folders, so nothing is skipped
or repeated however often a run dies.

The state is a history of one row per (file, run), the greatest delivery each. A batch adds
to it and works out anew the files it touches: those delivered, those that waited for a
success which has come since, and all if the success of an earlier run has changed. Their
rows in the sink, which carry the batch as their offset, replace older rows of the same
file; so a late record corrects the runs it concerns.

Defined results: deliveries with success false, a null file_hash, a null path, a
null run or a null record_id do not count; a null success counts; a null compile_args_hash is an empty
one; letter case of hashes does not matter; a null indexed_at is the oldest; ties
in indexed_at go to the greatest record_id.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import _fs, scratch_path

#: Partitions of the log, each with its own offset: what a plan holds never depends on the data's size.
PARTITIONS = 16
#: Batches after which the history is merged into one table.
MERGE_AFTER = 16
_HISTORY = "file_path string, run_id long, best struct<indexed_at:timestamp_ntz,record_id:bigint,file_hash:string,args_hash:string>"
_SINK = "file_path string, run_id long, offset long, file_hash string, args_hash string, change string"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file whole or not at all; names are never used twice."""
    fs, p = _fs(spark, path + ".tmp")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(p, _fs(spark, path)[1]):
        raise OSError(f"{path} is there already")


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def succeeded_after(goods: DataFrame, log_runs: DataFrame) -> DataFrame:
    """(run_id, eff_run): the first succeeded run (``goods``: run_id) at or after each run; runs after the last one are left out."""
    good = goods.select("run_id", F.col("run_id").alias("good"))
    every = good.unionByName(log_runs.select("run_id", F.lit(None).cast("long").alias("good"))).groupBy("run_id").agg(F.max("good").alias("good"))
    # One row per run, so a single window over them is small whatever the log holds.
    up = W.orderBy("run_id").rowsBetween(0, W.unboundedFollowing)
    return every.select("run_id", F.first("good", ignorenulls=True).over(up).alias("eff_run")).filter("eff_run IS NOT NULL")


class ChangeCapture:
    """Incremental capture of changed files into ``state_dir`` (shared by all executors).

    ``arrivals`` bounds how far a batch moves on in the order of arrival; None takes in all there is.
    """

    def __init__(self, spark: SparkSession, state_dir: str | None = None, partitions: int = PARTITIONS, arrivals: int | None = None):
        self.spark, self.dir, self.partitions, self.arrivals = spark, state_dir or scratch_path(spark, "capture"), partitions, arrivals

    # --- plans and commits
    def _last(self, what: str) -> int:
        return max([int(n.split(".")[0]) for n in _names(self.spark, f"{self.dir}/{what}") if n.endswith(".json")], default=0)

    def _json(self, what: str, k: int) -> dict:
        return json.loads(_read_text(self.spark, f"{self.dir}/{what}/{k}.json"))

    def _part(self):
        return F.pmod(F.xxhash64("file_path"), F.lit(self.partitions)).cast("int")

    def _goods(self, k: int) -> DataFrame:
        return self.spark.read.schema("run_id long").parquet(f"{self.dir}/runs/{k}")

    def plan(self, log: DataFrame, runs: DataFrame) -> dict | None:
        """The batch to do next: one that never committed, else a new one, or None."""
        k = self._last("commits")
        if self._last("plans") > k:
            return self._json("plans", k + 1)
        before = self._json("plans", k) if k else {"until": {}, "run": None, "print": None}
        after = before["until"]
        ahead = log.filter(F.col("record_id") > min(after.values())) if len(after) == self.partitions else log
        ends = {str(r["p"]): (r["lo"], r["hi"]) for r in ahead.filter("record_id IS NOT NULL").groupBy(self._part().alias("p")).agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi")).collect()}
        ends = {p: (max(lo - 1, after.get(p, lo - 1)), hi) for p, (lo, hi) in ends.items() if hi > after.get(p, lo - 1)}
        good = runs.filter((F.col("status") == "succeeded") & F.col("run_id").isNotNull()).select(F.col("run_id").cast("long").alias("run_id")).distinct()
        mark = F.concat_ws("/", F.count(F.lit(1)), F.sum(F.xxhash64("run_id").cast("decimal(38,0)")).cast("string"))
        now = good.agg(F.max("run_id").alias("last"), mark.alias("print")).first()
        if not ends and now["print"] == before["print"]:
            return None
        old = good.filter(F.col("run_id") <= before["run"]).agg(mark.alias("print")).first()["print"] if before["run"] is not None else before["print"]
        stop = min(lo for lo, _ in ends.values()) + self.arrivals if ends and self.arrivals else None
        until = {p: hi if stop is None else min(hi, stop) for p, (lo, hi) in ends.items() if stop is None or stop > lo}
        good.coalesce(1).write.mode("overwrite").parquet(f"{self.dir}/runs/{k + 1}")
        plan = {"batch": k + 1, "run": now["last"], "print": now["print"], "since": before["run"], "all": bool(k) and before["run"] is not None and old != before["print"], "after": after, "until": after | until}
        _write_text(self.spark, f"{self.dir}/plans/{k + 1}.json", json.dumps(plan))
        return plan

    def _batch(self, log: DataFrame, plan: dict) -> DataFrame:
        """Log rows of the plan: per partition those after its start and up to its end offset."""
        moved = {p: end for p, end in plan["until"].items() if end != plan["after"].get(p)}
        if not moved:
            return log.limit(0)
        part, at, lows = self._part(), F.col("record_id"), [plan["after"].get(p) for p in moved]
        within = F.lit(False)
        for p, end in moved.items():
            one = (part == int(p)) & (at <= end)
            within |= one & (at > plan["after"][p]) if p in plan["after"] else one
        # These bounds reach the scan, so row groups of other arrivals are not read.
        rows = log.filter(at <= max(moved.values()))
        return (rows if None in lows else rows.filter(at > min(lows))).filter(within)

    def _history(self, k: int) -> DataFrame:
        """One row per (file, run) and batch, up to batch ``k``."""
        base = self._json("commits", k)["base"] if k else 0
        paths = ([f"{self.dir}/history/base={base}"] if base else []) + [f"{self.dir}/history/batch={b}" for b in range(base + 1, k + 1)]
        return self.spark.read.schema(_HISTORY).parquet(*paths) if paths else self.spark.createDataFrame([], _HISTORY)

    # --- one batch
    def run(self, log: DataFrame, runs: DataFrame, fail_before_commit: bool = False) -> bool:
        """Do the next batch; False if there is nothing new. ``fail_before_commit`` is for tests."""
        plan = self.plan(log, runs)
        if plan is None:
            return False
        k = plan["batch"]
        rows = self._batch(log, plan).filter("run_id IS NOT NULL AND file_path IS NOT NULL AND file_hash IS NOT NULL AND coalesce(success, true)")
        best = F.struct(F.col("indexed_at").cast("timestamp_ntz").alias("indexed_at"), F.col("record_id").cast("long").alias("record_id"), F.lower("file_hash").alias("file_hash"), F.lower(F.coalesce("compile_args_hash", F.lit(""))).alias("args_hash"))
        rows.groupBy("file_path", F.col("run_id").cast("long").alias("run_id")).agg(F.max(best).alias("best")).write.mode("overwrite").parquet(f"{self.dir}/history/batch={k}")
        fresh = self.spark.read.schema(_HISTORY).parquet(f"{self.dir}/history/batch={k}")
        old = self._history(k - 1)
        states = old.unionByName(fresh)
        if k > 1 and not plan["all"]:
            touched = fresh.select("file_path")
            if plan["run"] != plan["since"]:  # what waited for a success
                touched = touched.unionByName(old.filter(F.col("run_id") > F.lit(plan["since"] if plan["since"] is not None else -(2**63))).select("file_path"))
            states = states.join(touched.distinct(), "file_path", "left_semi")
        goods = succeeded_after(self._goods(k), states.select("run_id").distinct())
        per_run = states.groupBy("file_path", "run_id").agg(F.max("best").alias("best")).join(goods, "run_id", "left")
        per_run = per_run.groupBy("file_path", "eff_run").agg(F.max("best").alias("best"))  # at most one row per file and run
        by = W.partitionBy("file_path").orderBy(F.col("eff_run").asc_nulls_last())
        so_far = per_run.withColumn("best", F.max("best").over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("was", F.lag("best").over(by))
        new = F.col("was").isNull()
        moved = F.col("eff_run").isNotNull() & (new | (F.col("was.file_hash") != F.col("best.file_hash")) | (F.col("was.args_hash") != F.col("best.args_hash")))
        # A file whose row waits for a success keeps one row without a run, which takes the place of older ones.
        kept = so_far.filter(moved | F.col("eff_run").isNull())
        kept.select("file_path", F.col("eff_run").alias("run_id"), F.col("best.record_id").alias("offset"), F.col("best.file_hash").alias("file_hash"), F.col("best.args_hash").alias("args_hash"), F.when(new, "added").otherwise("modified").alias("change")).write.mode("overwrite").parquet(f"{self.dir}/sink/batch={k}")
        base = self._json("commits", k - 1)["base"] if k > 1 else 0
        if k - base >= MERGE_AFTER:
            old.unionByName(fresh).groupBy("file_path", "run_id").agg(F.max("best").alias("best")).write.mode("overwrite").parquet(f"{self.dir}/history/base={k}")
            base = k
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        _write_text(self.spark, f"{self.dir}/commits/{k}.json", json.dumps({"batch": k, "base": base}))
        return True

    def changes(self) -> DataFrame:
        """All committed changes, once per (run_id, file_path): of each file those of its latest batch."""
        k = self._last("commits")
        if not k:
            return self.spark.createDataFrame([], _SINK).select("run_id", "file_path", "offset", "file_hash", "args_hash", "change")
        one = lambda b: self.spark.read.schema(_SINK).parquet(f"{self.dir}/sink/batch={b}").withColumn("batch", F.lit(b))
        rows = one(1)
        for b in range(2, k + 1):
            rows = rows.unionByName(one(b))
        if k > 1:
            top = F.max("batch").over(W.partitionBy("file_path"))  # a file has at most one row per run and batch
            rows = rows.withColumn("top", top).filter("batch = top")
        return rows.filter("run_id IS NOT NULL").select("run_id", "file_path", "offset", "file_hash", "args_hash", "change")


def capture_changes(file_metadata: DataFrame, index_runs: DataFrame, state_dir: str | None = None, batches: int = 1) -> DataFrame:
    """Changes of every succeeded run not captured yet in ``state_dir`` (a fresh one unless given) and before, taken in by so many batches."""
    capture = ChangeCapture(file_metadata.sparkSession, state_dir, arrivals=arrivals_of(file_metadata, batches))
    while capture.run(file_metadata, index_runs):
        pass
    return capture.changes()


def arrivals_of(log: DataFrame, batches: int) -> int | None:
    """How far a batch moves on so that ``batches`` take in the whole ``log``."""
    if batches <= 1:
        return None
    lo, hi = log.agg(F.min("record_id"), F.max("record_id")).first()
    return None if lo is None else -(-(hi - lo + 1) // batches)
