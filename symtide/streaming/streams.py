"""Structured Streaming variants: keyed merges, header claims and error rates as data arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import definition_wins
from ..operators.store import Table


def follow(spark: SparkSession, sf_dir: str, name: str, files_at_once: int = 8) -> DataFrame:
    """A table of the data directory as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.parquet").parquet(_folder(sf_dir, name))


def _folder(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet*"


def run_once(df: DataFrame, each_batch, checkpoint: str, mode: str = "append") -> None:
    """Work off all that is there; ``checkpoint`` makes a rerun go on where this one ended."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each_batch).start().awaitTermination()


def merge_symbols(spark: SparkSession, stream: DataFrame, store: Table, checkpoint: str) -> DataFrame:
    """Merge arriving symbol rows into ``store``, definition wins; batches may repeat without harm."""

    def merge(batch: DataFrame, _: int) -> None:
        old = store._pointer()
        store.commit(definition_wins(batch if old is None else store.read().unionByName(batch)))

    run_once(stream, merge, checkpoint)
    return store.read()


def replace_by_file(spark: SparkSession, stream: DataFrame, store: Table, checkpoint: str, version: str = "version", key: str = "file") -> DataFrame:
    """The rows of each file's greatest ``version`` (a column of the stream): a newer delivery replaces a file whole.

    A delivery may be spread over any number of batches, and come again: rows of the version a file already has
    join it, older ones are left out.
    """

    def put(batch: DataFrame, _: int) -> None:
        rows = batch if store._pointer() is None else store.read().unionByName(batch)
        newest = rows.groupBy(key).agg(F.max(version).alias("__v"))
        met = rows.join(newest, key).filter(F.col(version).eqNullSafe(F.col("__v"))).drop("__v")
        store.commit(met.select(*stream.columns).distinct())

    run_once(stream, put, checkpoint)
    return store.read()


def claim_headers(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The first delivery of each (file, hash); the state of a pair is dropped when it is older than ``late``."""
    return stream.withColumn("at", F.col("indexed_at").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["file_path", "file_hash"])


def error_rate(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Calls and errors per window; windows close once the watermark has passed them."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window)).agg(F.count(F.lit(1)).alias("n_calls"), F.count(F.when(F.col("event_type") == "error", 1)).alias("n_errors"))
