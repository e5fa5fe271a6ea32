"""Session plumbing: shipping the package to executors and durable intermediate tables."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_SHIPPED = "spark.quillspark.shipped"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``, whatever store that path is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers.

    One small archive of the package's sources goes through Spark's file server;
    on one machine nothing is sent when PYTHONPATH holds the checkout.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return
    if not re.fullmatch(r"local(\[.*\])?", sc.master) or str(_ROOT.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(_ROOT.rglob("*.py")):
                z.write(p, p.relative_to(_ROOT.parent))
        path = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark_pkg.zip"
        path.write_bytes(buf.getvalue())
        sc.addPyFile(str(path))
    sc._quillspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, as in tests on one machine, a fresh temporary
    folder takes its place; a cluster without it is an error, since its machines
    see no folder of each other's.
    """
    sc = spark.sparkContext
    got = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = getattr(sc, "_quillspark_dir", None)
        if got is None:
            got = sc._quillspark_dir = "file://" + tempfile.mkdtemp(prefix="quillspark-shared-")
    return got


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table replaces the lineage: an executor lost later costs a
    reread of these files and not a recomputation, and no block is kept on one
    machine only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._stash = path
    spark.sparkContext.__dict__.setdefault("_quillspark_stashes", set()).add(path)
    return got


def discard(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing reads any more."""
    path, sc = getattr(df, "_stash", None), df.sparkSession.sparkContext
    if path:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        sc.__dict__.get("_quillspark_stashes", set()).discard(path)


def sweep(spark: SparkSession) -> int:
    """Delete every stashed table of this session, once its results are written; how many there were."""
    paths = list(spark.sparkContext.__dict__.get("_quillspark_stashes", ()))
    for path in paths:
        df = spark.range(0)
        df._stash = path
        discard(df)
    return len(paths)


def spread(df: DataFrame, small: int = 64 << 20) -> DataFrame:
    """``df`` dealt over all cores when its input is too small for Spark to split.

    A file of one row group is one task however many cores wait. Large inputs
    come back as they are, so there is no shuffle where it would cost something.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores) if size < small * cores else df
