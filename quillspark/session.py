"""A local session for trying things out."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A SparkSession on this machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
