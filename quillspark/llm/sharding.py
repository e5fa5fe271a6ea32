"""Operator 10: rendezvous hashing of record keys over weighted shards (native).

Each (key, shard) pair has a hash ``u`` in (0, 1]; a key goes to the shard with
the smallest ``-ln(u) / weight``. The law is ``key``: nothing but the key and the
shards decide, so one more shard takes keys only into itself.

Slots number a shard's rows without gaps. Rows carry the number of the input
partition that read them; per (shard, partition) counts give each such run its
first slot, so no task ever sorts a whole shard.

Defined results: a null text has size 16 and crc 0; null keys share one hash;
equal keys share a shard and get slots of their own; an empty table gives no
rows; other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import stash, table


def rendezvous(key: Column, shards: int, weights: list[float] | None = None) -> Column:
    """The shard, from 0, that ``key`` goes to."""
    w = F.array(*[F.lit(float(x)) for x in (weights or [1.0] * shards)])
    unit = lambda s: (F.shiftrightunsigned(F.xxhash64(key, s), 11) + 1) / F.lit(float(1 << 53))
    cost = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct((-F.log(unit(s)) / F.element_at(w, s + 1)).alias("cost"), s.alias("shard")),
    )
    return F.array_min(cost)["shard"]


def shard(docs: DataFrame, shards: int = 40, weights: list[float] | None = None, key: str = "doc_id") -> DataFrame:
    """``docs`` without other columns, with shard, slot and the shard after one more joins."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    grown = None if weights is None else [*weights, sum(weights) / len(weights)]
    rows = docs.select(
        F.col(key),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), shards, weights).cast("int").alias("shard"),
        rendezvous(F.col(key), shards + 1, grown).cast("int").alias("grown_shard"),
        F.spark_partition_id().alias("run"),
    )
    rows = stash(rows, "shard")
    runs = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "run").orderBy(key, "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(within))
        .join(runs, ["shard", "run"])
        .select(
            key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("first") + F.col("nth") - 1).cast("bigint").alias("slot"), "grown_shard",
        )
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal weight."""
    return shard(table(spark, sf_dir, "documents"))
