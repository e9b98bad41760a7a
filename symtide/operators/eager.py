"""A few keys holding most records: per-key results without a straggling task.

Method: eager aggregation through joins. Both inputs of a join are aggregated by
the join key first; only the compact states meet, and their counts are multiplied
or their sums combined before the roll-up. No raw row of a hot key is ever joined
or gathered, and the distinct counts go over (key, partner) pairs, whose hash
spreads a hot key over all tasks.

Defined results: null and blank keys belong to no key but count in the total;
repeated rows count each time; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import blank, materialize, skew_join

#: Share of all rows from which on a key dominates, in percent.
DOMINANT_PERCENT = 2


def _full(c: str) -> Column:
    return F.col(c).rlike(r"\S")


def side_states(call_sites: DataFrame) -> DataFrame:
    """(usr, n_caller, n_callee) of every key: the caller side and the callee side aggregated by key first, then their states joined."""
    one = lambda c: call_sites.filter(_full(c)).groupBy(F.col(c).alias("usr")).agg(F.count(F.lit(1)).alias(f"n_{c.split('_')[0]}"))
    met = one("caller_usr").join(one("callee_usr"), "usr", "full_outer")
    return met.select("usr", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_caller", "n_callee")))


def key_states(call_sites: DataFrame) -> DataFrame:
    """The compact state of every key of either side, rolled up from the joined states: (side, usr, n_sites)."""
    pair = F.array(*(F.struct(F.lit(side).alias("side"), F.col(f"n_{side}").alias("n_sites")) for side in ("caller", "callee")))
    return side_states(call_sites).select("usr", F.explode(pair).alias("s")).select("s.side", "usr", "s.n_sites").filter("n_sites > 0")


def dominant_keys(call_sites: DataFrame, percent: int = DOMINANT_PERCENT) -> DataFrame:
    """(side, usr, n_sites) of the keys that hold at least ``percent`` of all rows."""
    total = call_sites.count()
    return key_states(call_sites).filter(F.col("n_sites") * 100 >= F.lit(percent * total))


def key_profile(call_sites: DataFrame, percent: int = DOMINANT_PERCENT) -> DataFrame:
    """Per side and usr: sites, distinct partners, distinct files, and whether the key dominates.

    Both sides roll up from one table of (caller, callee, file) states; the distinct files of a
    key come from its (key, file) states, so no set of files is ever held.
    """
    total = call_sites.count()
    states = materialize(call_sites.groupBy("caller_usr", "callee_usr", "file").agg(F.count(F.lit(1)).alias("n")), "states")

    def side(name: str, usr: str, partner: str) -> DataFrame:
        mine = states.filter(_full(usr))
        partners = mine.groupBy(F.col(usr).alias("usr"), F.col(partner).alias("partner")).agg(F.sum("n").alias("n")).groupBy("usr").agg(F.sum("n").alias("n_sites"), F.count(F.when(~blank(F.col("partner")), 1)).alias("n_partners"))
        files = mine.filter(F.col("file").isNotNull()).select(F.col(usr).alias("usr"), "file").distinct().groupBy("usr").agg(F.count(F.lit(1)).alias("n_files"))
        met = partners.join(files, "usr", "left")
        return met.select(F.lit(name).alias("side"), "usr", "n_sites", "n_partners", F.coalesce("n_files", F.lit(0)).alias("n_files"), (F.col("n_sites") * 100 >= F.lit(percent * total)).alias("dominant"))

    return side("caller", "caller_usr", "callee_usr").unionByName(side("callee", "callee_usr", "caller_usr"))


def eager_join_count(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, n): how many rows ``left`` JOIN ``right`` ON key has per key, without that join."""
    a = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, key).select(key, (F.col("a") * F.col("b")).alias("n"))


def two_step_chains(call_sites: DataFrame) -> DataFrame:
    """(usr, n_chains): pairs of a call into usr and a call out of it, counted from the key states."""
    into = call_sites.filter(F.col("callee_usr").rlike(r"\S")).select(F.col("callee_usr").alias("usr"))
    out = call_sites.filter(F.col("caller_usr").rlike(r"\S")).select(F.col("caller_usr").alias("usr"))
    return eager_join_count(into, out, "usr").withColumnRenamed("n", "n_chains")


def kind_matrix(call_sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller_kind, callee_kind, n_rows) of call_sites JOIN symbols twice, with every row of a usr.

    Pairs of usrs and (usr, kind) states are aggregated first; the caller side is
    joined and rolled up to (callee, caller_kind) before the callee side comes in.
    """
    kinds = symbols.filter(F.col("usr").isNotNull()).groupBy("usr", "kind").agg(F.count(F.lit(1)).alias("m"))
    kinds = materialize(kinds.groupBy("usr").agg(F.collect_list(F.struct("kind", "m")).alias("kinds")), "kinds")
    pairs = materialize(call_sites.groupBy("caller_usr", "callee_usr").agg(F.count(F.lit(1)).alias("n")), "pairs")
    total = pairs.count()
    first = skew_join(pairs, kinds.withColumnRenamed("usr", "caller_usr"), "caller_usr", total, "inner").select("callee_usr", "n", F.explode("kinds").alias("k"))
    first = materialize(first.groupBy("callee_usr", F.col("k.kind").alias("caller_kind")).agg(F.sum(F.col("n") * F.col("k.m")).alias("n")), "first")
    second = skew_join(first, kinds.withColumnRenamed("usr", "callee_usr"), "callee_usr", total, "inner").select("caller_kind", "n", F.explode("kinds").alias("k"))
    return second.groupBy("caller_kind", F.col("k.kind").alias("callee_kind")).agg(F.sum(F.col("n") * F.col("k.m")).alias("n_rows"))
