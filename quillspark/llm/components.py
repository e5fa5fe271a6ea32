"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import discard, stash


def _toward_min(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for the nodes of ``edges(u, v)``; a component is its smallest node.

    Each step is two grouped minima and joins; minima are taken before the
    shuffle, so a hub costs a row per task there. The minima of the first join are
    written before it: so it is a join of two plain shuffles, of which Spark splits
    the partition that a hub's edges make large. Every round is written to the shared
    folder, which cuts the lineage, and replaces the one before. Rounds grow as the logarithm of a
    component's size.
    """
    edges = stash(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        label,
    )
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = stash(_toward_min(both).select("u", F.least("u", "m").alias("m")), label)
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = _toward_min(large)
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        before, edges = edges, stash(small.where("u != v").distinct(), label)
        discard(before)
        discard(lowest)
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == known:
            break
        known = tuple(row)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
