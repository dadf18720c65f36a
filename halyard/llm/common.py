"""Shared helpers of the training-data operators: durable intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    Only where the session names none (tests on ``local[*]``) is a temporary
    folder made and set; on a cluster a missing setting is an error, since a
    machine-local folder would lose data.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        found = tempfile.mkdtemp(prefix="halyard-")
        sc.setCheckpointDir(found)
    return found


def _new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. What no :func:`discard` deletes (tables that
    a result reads lazily) goes when the driver's file systems close."""
    path = f"{shared_dir(spark).rstrip('/')}/halyard/{name}-{uuid.uuid4().hex}"
    system, target = _located(spark, path)
    system.mkdirs(target.getParent())
    system.deleteOnExit(target)
    return path


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


#: Files of a table that is written in few, at least.
FEW_FILES = 40


def materialize(df: DataFrame, name: str, codec: str = "zstd", few: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a
    lost executor costs a re-read, not a recomputation.

    few: for tables that a loop writes again and again, whose last step is an
    aggregation. They get a few files for each core, not one for each shuffle
    partition: on a local file system an executor starts commands for every file."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    if few:
        df = df.coalesce(max(FEW_FILES, 3 * spark.sparkContext.defaultParallelism))
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._halyard_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """:func:`materialize`, dealt and sorted by ``key``: later joins by it move
    only their other side."""
    spark = df.sparkSession
    path, table = _new_path(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key).sortWithinPartitions(key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._halyard_path, out._halyard_table = path, table
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables written by :func:`materialize` that no later plan reads."""
    for df in tables:
        path, table = getattr(df, "_halyard_path", None), getattr(df, "_halyard_table", None)
        if table is not None:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path is not None:
            system, target = _located(df.sparkSession, path)
            system.delete(target, True)


def trim() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if release is not None:
        release(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which its worker holds no freed memory: workers
    wait for later tasks, and what they keep counts in stages that don't use it."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def fresh_name(stem: str, columns: list[str]) -> str:
    """A column name that no column has, whatever the case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, alike in every engine and locale."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
