"""Shared-folder tables and exact distributed ranks, used by several operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df (in any case) is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits of a text from two seeds; a null text has those of none."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else (local runs and tests) a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Whole texts go to Python by at most so many rows meanwhile: a batch lies outside the heap on its way, and in Python twice. It holds for plans that run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """From now on no batch that the session hands to Python holds many more bytes; batches of numbers stay below that anyway.

    A plan takes the setting when it runs, so it has to stand for plans that run after their stage returned them.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= limit:
        spark.conf.set(key, str(limit))


def give_back() -> None:
    """Runs in a Python worker: memory that nothing uses any more goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def give_back_heaps(spark: SparkSession) -> None:
    """Executors collect their garbage and return the heap that is unused: a heavy stage lets it grow to its limit, and there it stays,
    beside the Python workers of the next one. One task a core, so that each executor gets some; a busy cluster may leave out a few."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def lean(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """run, for mapInPandas, giving memory back after each task: idle workers stay as long as the executor is busy, with what their last task left."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


_SAVED: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs don't recompute it, and a lost executor doesn't lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tideline_path = path
    _SAVED.append(path)
    return out


def forget(spark: SparkSession) -> None:
    """Delete every table saved by this process so far, once its results have been written elsewhere: plans that read them can't run again."""
    while _SAVED:
        p = spark._jvm.org.apache.hadoop.fs.Path(_SAVED.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete saved tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_tideline_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def with_rank(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """Rank 0.. within keys without gathering a key in one task.

    Rows of a key are dealt to buckets, sorted inside (key, bucket), and shifted by
    the rows of the buckets before; only the bucket counts meet per key. df is read
    twice, so it must be a saved table.
    """
    d = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    shift = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = d.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    on = (F.col("_bucket") == F.col("_b"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(shift, on).withColumn(name, F.col("_row") - 1 + F.col("_shift")).drop("_bucket", "_b", "_shift", "_row", *[f"_k{i}" for i in range(len(keys))])
