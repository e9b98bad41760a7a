"""Type aliases: resolution, mappings and expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alias_names(aliases: DataFrame) -> DataFrame:
    """(name, canonical_type): every short and qualified alias name; equal names keep the least canonical type."""
    names = aliases.select(F.explode(F.array_distinct(F.array("alias_name", "qualified_name"))).alias("name"), "canonical_type")
    return names.groupBy("name").agg(F.min("canonical_type").alias("canonical_type"))


def latest_aliases(aliases: DataFrame, order: str) -> DataFrame:
    """One row per qualified name: the last written."""
    rest = [c for c in aliases.columns if c != "qualified_name"]
    return aliases.groupBy("qualified_name").agg(F.max_by(F.struct(*rest), order).alias("s")).select("qualified_name", "s.*")


def alias_info(names: DataFrame, aliases: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, kind, canonical_type, n_aliases) of each asked ``name``: an alias first, else a class, else unknown;
    a simple name that several classes have is ambiguous."""
    known = alias_names(aliases)
    counts = aliases.groupBy("canonical_type").agg(F.count(F.lit(1)).alias("n_aliases"))
    matches = classes.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"), "qualified_name").groupBy("name").agg(F.countDistinct("qualified_name").alias("n_classes"), F.min("qualified_name").alias("class_name"))
    met = names.join(known, "name", "left").join(matches, "name", "left")
    kind = F.when(F.col("canonical_type").isNotNull(), "alias").when(F.col("n_classes") > 1, "ambiguous").when(F.col("n_classes") == 1, "class").otherwise("unknown")
    canonical = F.coalesce("canonical_type", F.when(F.col("n_classes") == 1, F.col("class_name")))
    got = met.select("name", kind.alias("kind"), canonical.alias("canonical_type"))
    return got.join(counts, "canonical_type", "left").select("name", "kind", "canonical_type", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"))


def expand_types(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, expanded): the name, its canonical type, and all aliases of either."""
    known = alias_names(aliases)
    canonical = names.join(known, "name").select("name", F.col("canonical_type").alias("expanded"))
    roots = names.select("name", F.col("name").alias("expanded")).unionByName(canonical)
    more = roots.join(known.select(F.col("canonical_type").alias("expanded"), F.col("name").alias("alias")), "expanded").select("name", F.col("alias").alias("expanded"))
    return roots.unionByName(more).distinct()
