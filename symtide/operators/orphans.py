"""References to records that do not exist, per reference and per table and period.

Method: keys are range-partitioned (equal ranges of the key's 64-bit hash, so no
sampling is needed), the parents of a range are kept as sorted arrays, and Arrow
batches of references are probed against them by binary search; the misses are
then aggregated. Ranges that hold many references are split over several salts,
each with its own copy of the range's parents, so a hot key never lands in one
task. References stream through; a task holds only the parents of its ranges.

Defined results: null and blank keys refer to nothing; a key in the permanent
parents is never an orphan; a reference without a time finds nobody alive, so its
reason is 'missing' or 'deleted'; a parent without created_at never lives but
keeps its key from being 'late'; repeated references each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: References that one range should hold; a range, or a salt of a split one, is one task.
RANGE_ROWS = 100_000
#: Key ranges (as a power of two) that are counted first; more only where there are too many references for these.
FINE_BITS = 14
_REASONS = np.array(["", "missing", "late", "deleted"], dtype=object)
_MAX = np.iinfo(np.int64).max


def _range(key: str, bits: int):
    return F.shiftright(F.xxhash64(key), 64 - bits).cast("int")


class _Parents:
    """The parents of a task's ranges as sorted arrays."""

    def __init__(self, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches) if batches else None
        if t is None or not t.num_rows:
            self.n = 0
            return
        usr = pc.dictionary_encode(t["key"].combine_chunks())
        usr = usr.combine_chunks() if isinstance(usr, pa.ChunkedArray) else usr
        words, code = usr.dictionary, usr.indices.to_numpy(zero_copy_only=False)
        h = np.zeros(len(words), dtype=np.int64)
        h[code] = t["h"].to_numpy()
        order = np.argsort(h, kind="stable")  # key ids in hash order
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.n, self.h, self.words = len(order), h[order], words.take(pa.array(order))
        rid = rank[code]
        made, gone, kept = (t[c].combine_chunks() for c in ("made", "gone", "kept"))
        self.kept = np.zeros(self.n, dtype=bool)
        self.kept[rid[kept.to_numpy(zero_copy_only=False)]] = True
        timed = ~made.is_null().to_numpy(zero_copy_only=False)
        untimed = np.zeros(self.n, dtype=bool)
        untimed[rid[~timed]] = True
        self.untimed = untimed
        at = pc.fill_null(made.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)[timed]
        off = pc.fill_null(gone.cast(pa.int64()), _MAX).to_numpy(zero_copy_only=False)[timed]
        rid = rid[timed]
        self.times = np.unique(at)
        step = len(self.times) + 1
        order = np.lexsort((at, rid))
        rid, at, off = rid[order], at[order], off[order]
        # Rows sorted by (key, created_at); per key the latest end among the rows created so far.
        self.spot = rid.astype(np.int64) * step + np.searchsorted(self.times, at) + 1
        self.step = step
        ends = np.maximum.accumulate  # per key below
        self.until = off.copy()
        for a, b in _segments(rid):
            if b - a > 1:
                self.until[a:b] = ends(off[a:b])
        self.first = np.searchsorted(rid, np.arange(self.n), side="left")

    def probe(self, h: np.ndarray, key: pa.Array, t: np.ndarray, has_t: np.ndarray) -> np.ndarray:
        """A reason number for every reference; 0 where the key lives at t."""
        out = np.ones(len(h), dtype=np.int8)
        if not self.n:
            return out
        k = np.searchsorted(self.h, h, side="left")
        todo = np.flatnonzero((k < self.n) & (self.h[np.minimum(k, self.n - 1)] == h))
        while len(todo):  # more than once round only where two keys share a hash
            same = pc.equal(self.words.take(pa.array(k[todo])), key.take(pa.array(todo))).to_numpy(zero_copy_only=False)
            hit = todo[same]
            out[hit] = self._judge(k[hit], t[hit], has_t[hit])
            todo = todo[~same]
            k[todo] += 1
            todo = todo[(k[todo] < self.n)]
            todo = todo[self.h[k[todo]] == h[todo]]
        return out

    def _judge(self, rid: np.ndarray, t: np.ndarray, has_t: np.ndarray) -> np.ndarray:
        spot = rid.astype(np.int64) * self.step + np.searchsorted(self.times, t, side="right")
        i = np.searchsorted(self.spot, spot, side="right") - 1  # the last row of the key created by t
        born = (i >= self.first[rid]) & has_t
        alive = born & (self.until[np.maximum(i, 0)] > t) if len(self.until) else np.zeros(len(rid), dtype=bool)
        late = has_t & ~born & ~self.untimed[rid]
        return np.where(self.kept[rid] | alive, 0, np.where(late, 2, 3)).astype(np.int8)


def _segments(sorted_ids: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_ids):
        edges = np.flatnonzero(np.diff(sorted_ids)) + 1
        yield from zip(np.r_[0, edges].tolist(), np.r_[edges, len(sorted_ids)].tolist())


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    parents: _Parents | None = None
    for b in batches:
        is_ref = b["ref"].to_numpy(zero_copy_only=False)
        n = int(np.argmax(is_ref)) if is_ref.any() else len(is_ref)  # parents come first
        if n:
            held.append(b.slice(0, n))
        if n == len(is_ref):
            continue
        if parents is None:
            parents = _Parents(held)
            held = []
        refs = b.slice(n)
        made = refs["made"]
        t = pc.fill_null(made.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        why = parents.probe(refs["h"].to_numpy(), refs["key"], t, ~made.is_null().to_numpy(zero_copy_only=False))
        miss = np.flatnonzero(why)
        if len(miss):
            got = refs.take(pa.array(miss))
            yield pa.RecordBatch.from_arrays(
                [got["id"], got["side"], got["key"], pa.array(_REASONS[why[miss]], type=pa.string()), got["made"]], names=["ref_id", "side", "key", "reason", "made"]
            )


def _counts(refs: DataFrame, bits: int) -> tuple[pd.DataFrame, int]:
    """References in each of 2**bits key ranges, and in all."""
    got = refs.groupBy(_range("key", bits).alias("r")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    return got, int(got["n"].sum())


def orphan_references(refs: DataFrame, parents: DataFrame, range_rows: int = RANGE_ROWS, fine_bits: int = FINE_BITS) -> DataFrame:
    """Misses of ``refs`` (ref_id long, side, key, made) among ``parents`` (key, made, gone, kept).

    A parent lives from ``made`` until ``gone`` (null: for good); with ``kept`` it
    always exists. Gives (ref_id, side, key, reason, made).
    """
    refs = refs.filter(F.col("key").rlike(r"\S"))
    # One number per key range comes to the driver: they say how many ranges to make and which to split.
    fine, total = _counts(refs, fine_bits)
    wanted = max(1, (total // range_rows).bit_length())
    if wanted > fine_bits:
        fine_bits = wanted
        fine, total = _counts(refs, fine_bits)
    bits = min(fine_bits, wanted)
    at = _range("key", bits)
    lowest = -(1 << fine_bits - 1)  # the hash is signed
    counts = np.zeros(1 << bits, dtype=np.int64)
    np.add.at(counts, (fine["r"].to_numpy() - lowest) >> (fine_bits - bits), fine["n"].to_numpy())
    each = max(range_rows, total >> bits)
    split = np.flatnonzero(counts > 2 * each)  # at most total / (2 * each) ranges, that is half of them
    salts = -(-counts[split] // each)
    first = (1 << bits) + np.r_[0, np.cumsum(salts - 1)][: len(split)]  # the further salts of a range are tasks behind all ranges
    base = lowest >> (fine_bits - bits)
    many = [(int(r) + base, int(k), int(f)) for r, k, f in zip(split, salts, first)]
    # A table for a broadcast join, bounded as the ranges are.
    told = F.broadcast(refs.sparkSession.createDataFrame(many, "r int, salts int, first int")) if many else None
    salted = lambda df: df.join(told, "r", "left").withColumn("salts", F.coalesce("salts", F.lit(1))) if many else df.withColumns({"salts": F.lit(1), "first": F.lit(0)})
    task = F.when(F.col("salt") > 0, F.col("first") + F.col("salt") - 1).otherwise(F.col("r") - base).cast("int")
    tasks = (1 << bits) + int((salts - 1).sum())
    kind = dict(refs.dtypes)["made"]
    probes = refs.select(
        F.lit(True).alias("ref"), F.xxhash64("key").alias("h"), "key", "made", F.lit(None).cast(kind).alias("gone"), F.lit(False).alias("kept"), F.col("ref_id").alias("id"), "side", at.alias("r")
    )
    probes = salted(probes).withColumn("salt", F.pmod(F.hash("id"), F.col("salts"))).withColumn("task", task).drop("salts", "first", "salt")
    held = parents.filter(F.col("key").isNotNull()).select(
        F.lit(False).alias("ref"), F.xxhash64("key").alias("h"), "key", F.col("made").cast(kind).alias("made"), F.col("gone").cast(kind).alias("gone"), F.coalesce("kept", F.lit(False)).alias("kept"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("side"), at.alias("r")
    )
    held = salted(held.distinct()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("task", task).drop("salts", "first", "salt")
    met = held.unionByName(probes).repartitionById(tasks, "task").sortWithinPartitions("ref").drop("r", "task")
    return met.mapInArrow(_probe, f"ref_id long, side string, key string, reason string, made {kind}")


def call_orphans(call_sites: DataFrame, symbols: DataFrame, dependency_symbols: DataFrame) -> DataFrame:
    """(call_site_id, side, usr, reason, created_at) of the call references that nobody answers."""
    pair = F.array(F.struct(F.lit("caller").alias("side"), F.col("caller_usr").alias("key")), F.struct(F.lit("callee").alias("side"), F.col("callee_usr").alias("key")))
    refs = call_sites.select(F.col("call_site_id").alias("ref_id"), F.explode(pair).alias("s"), F.col("created_at").alias("made")).select("ref_id", "s.side", "s.key", "made")
    kind = dict(refs.dtypes)["made"]
    parents = symbols.select(F.col("usr").alias("key"), F.col("created_at").alias("made"), F.col("removed_at").alias("gone"), F.lit(False).alias("kept")).unionByName(
        dependency_symbols.select(F.col("usr").alias("key"), F.lit(None).cast(kind).alias("made"), F.lit(None).cast(kind).alias("gone"), F.lit(True).alias("kept"))
    )
    return orphan_references(refs, parents).select(F.col("ref_id").alias("call_site_id"), "side", F.col("key").alias("usr"), "reason", F.col("made").alias("created_at"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(side, reason, month, n_refs, n_usrs) of ``call_orphans``."""
    keyed = orphans.groupBy("side", "reason", F.date_trunc("month", "created_at").cast("date").alias("month"), "usr").agg(F.count(F.lit(1)).alias("n"))
    return keyed.groupBy("side", "reason", "month").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_usrs"))
