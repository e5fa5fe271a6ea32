"""Parsing each distinct content once: the parse cache as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.columns import DEFAULT, hash_content, md_parse
from quillspark.functions.handlers import Handlers, md_parse_with
from quillspark.kernel.model import Options
from quillspark.runtime import stash


def config_key(options: Options, handlers: Handlers | None = None) -> str:
    """A text that is equal for parses that give equal trees; empty if nothing can tell, as with a function that changes lines."""
    if handlers is None:
        return options.key()
    return "" if handlers.text or any(h.parse or h.options for h in handlers.custom) or any(h.parse for h in handlers.custom_roles) else f"{options.key()}|{handlers.strict}|{','.join(handlers.names)}"


def with_hashes(docs: DataFrame, options: Options = DEFAULT, source: str = "source", handlers: Handlers | None = None) -> DataFrame:
    """``docs`` with the two hashes that key a parse; the second is empty where parses must not be shared."""
    key = config_key(options, handlers)
    return docs.withColumns({"content_hash": hash_content(F.col(source)), "config_hash": F.sha2(F.lit(key), 256) if key else F.lit("")})


def parse_many(docs: DataFrame, options: Options = DEFAULT, cache: DataFrame | None = None, source: str = "source", handlers: Handlers | None = None) -> DataFrame:
    """``docs`` with ``ast``: rows of equal content share one parse, and parses in ``cache`` are taken from there.

    ``cache`` has (content_hash, config_hash, ast). Contents are made distinct
    before the shuffle, so many copies of one document cost one row per task. The
    parses are written before they are joined, so Spark can split the rows of a
    content that very many documents share. With an empty ``config_hash`` every
    row is parsed by itself.
    """
    keyed = with_hashes(docs, options, source, handlers)
    make = (lambda c: md_parse(c, options)) if handlers is None else (lambda c: md_parse_with(c, handlers, options))
    if not config_key(options, handlers):
        return keyed.withColumn("ast", make(F.col(source)))
    todo = keyed.groupBy("content_hash", "config_hash").agg(F.first(source).alias("text"))
    if cache is not None:
        todo = todo.join(cache.select("content_hash", "config_hash"), ["content_hash", "config_hash"], "left_anti")
    done = todo.select("content_hash", "config_hash", make(F.col("text")).alias("ast"))
    if cache is not None:
        done = done.unionByName(cache.select("content_hash", "config_hash", "ast"))
    return keyed.join(stash(done, "parses"), ["content_hash", "config_hash"])


class StoredCache:
    """Parses in a folder of Parquet files, for later runs; ``parse_many`` takes ``table()`` and ``add`` keeps what it made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame | None:
        """(content_hash, config_hash, ast) of all parses; None before the first."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.parquet(self.path) if there else None

    def add(self, parsed: DataFrame) -> None:
        """Keep the parses of these rows that the folder lacks; rows that must not be shared are passed over."""
        new = parsed.where("config_hash != ''").groupBy("content_hash", "config_hash").agg(F.first("ast").alias("ast"))
        known = self.table()
        if known is not None:
            new = new.join(known.select("content_hash", "config_hash"), ["content_hash", "config_hash"], "left_anti")
        new.write.mode("append").parquet(self.path)


def profile(docs: DataFrame, source: str = "source", ast: str = "ast") -> DataFrame:
    """One row of totals: parse calls, characters, top-level blocks, nodes."""
    top = F.size(F.filter(ast, lambda n: n["depth"] == 1))
    return docs.agg(
        F.count(F.lit(1)).alias("parse_calls"), F.sum(F.length(source)).alias("source_length"),
        F.sum(top).alias("node_count"), F.sum(F.size(ast)).alias("all_nodes"),
    )
