"""Shared storage, small SQL helpers and connected components for the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of local applications that name none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent, a local master gets a temporary folder of its own;
    any other master is refused, for a machine-local folder would lose data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tidewatch-")
        found = _own[app]
    return found.rstrip("/")


#: Rows and bytes of an Arrow batch at most, so that what a task holds doesn't depend on how long texts are.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES where they are higher."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(name, None) or "").lower().removesuffix("b")
        if not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def url(folder: str) -> str:
    """A folder as a URL that pyarrow opens."""
    if folder.startswith("file:"):
        return "file:///" + folder.removeprefix("file:").lstrip("/")
    return folder if "://" in folder else f"file://{os.path.abspath(folder)}"


def tidy(run: Callable) -> Callable:
    """An Arrow function after whose last batch the worker, which Spark uses again, gives unused memory back to the system."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return wrapped


#: Rows up to which a table of a few numbers a row is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Bytes of a row group of intermediate tables: what a writing task holds.
ROW_GROUP = 16 << 20


class Scratch:
    """Tables and files of one operator run below the shared folder; rereading them cuts the lineage.

    They stay when the operator returns, as its result reads them; ``close`` deletes them.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/tidewatch/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def close(self) -> None:
        """Delete all of it, once nothing that reads it is in use."""
        self.drop("")

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, root)`` of every node that has an edge.

    Alternating large-star and small-star steps: each replaces a node's neighbours by
    links to its smallest neighbour. Edges are kept with the larger node first, so a
    large-star step needs the least smaller neighbour of the smaller node alone; a root
    has none, and its neighbours, however many, meet nothing. Minima are taken with
    partial aggregation and joined back, so the neighbours of a hub are never gathered in
    one value, and a skewed partition of the join can be split. The edge set of each
    round is written to the shared folder; rounds go on until every edge leads to a root.
    """

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("m"))

    now, k = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0"), 0
    while not now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
        large = now.join(least(now).withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        small = large.join(least(large), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        k += 1
        now = scratch.write(small.filter("u <> v").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
