"""Shared plumbing of the text operators: durable intermediate tables and skew-safe plans.

Intermediate results are Parquet tables below ``spark.checkpoint.dir``, which every executor and
the driver can see, so a lost executor never loses them and their lineage is cut.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Broadcast only tables of at most so many rows (each a few longs wide).
BROADCAST_ROWS = 200_000
#: Rows by task of tables whose size is known beforehand.
ROWS_A_TASK = 16_384

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where none is configured and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/barloom/{uuid.uuid4().hex}/{name}"


def fitted(df: DataFrame, rows: int | None = None, a_task: int = ROWS_A_TASK) -> DataFrame:
    """``df`` in no more tasks than ``rows`` rows (its own, as counted, by default) need; never in more than it has. Small tables thus go
    through one task, without any exchange; a large one keeps its tasks. Not for what a stage reads from large tables: they would be read by these tasks."""
    rows = getattr(df, "n_rows", None) if rows is None else rows
    if rows is None or rows > a_task << 16:
        return df
    return df.coalesce(max(1, -(-rows // a_task)))


def materialize(df: DataFrame, name: str, at_most: int | None = None, **metrics: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and later joins see plain scans,
    which lets adaptive execution split their skewed partitions. ``n_rows`` of the result and its ``metrics`` are counted while writing.
    ``at_most``: a bound of its rows, for ``fitted``, where the last stage follows an exchange or reads small tables."""
    spark, seen = df.sparkSession, Observation()
    if at_most is not None:
        df = fitted(df, at_most)
    path = fresh_path(spark, name)
    df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[v.alias(k) for k, v in metrics.items()]).write.parquet(path)
    if _scratches:
        _scratches[-1].paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    for k, v in seen.get.items():
        setattr(out, k, v)
    return out


def small(df: DataFrame, at_most: int | None = None) -> DataFrame:
    """Broadcast ``df`` if a count, or the bound ``at_most``, shows that it is small; otherwise leave the join to a shuffle."""
    n = getattr(df, "n_rows", None) if at_most is None else at_most
    if n is None:
        n = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


_scratches: list[Scratch] = []


class Scratch:
    """The tables materialized within a ``scratch`` block."""

    def __init__(self):
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, whose table outlives the block; it must be the latest of ``materialize``."""
        path = self.paths.pop()
        if len(_scratches) > 1:
            _scratches[-2].paths.append(path)
        return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables materialized inside are deleted at the end, but for the one kept; nothing lazy may still read them."""
    own = Scratch()
    _scratches.append(own)
    try:
        yield own
    finally:
        _scratches.remove(own)
        for path in own.paths:
            remove(spark, path.rpartition("/")[0])
        release(spark)


def release(spark: SparkSession) -> None:
    """Let the driver give back what earlier queries left: plans that Python still holds in cycles, broadcasts, and classes generated for them.
    The JVM unloads those, and shrinks its heap, in full collections only, which it puts off while the heap has room."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hadoop(spark: SparkSession, path: str):
    """(file system, Path) of any path Spark can read."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)
