"""Folders for queries that need stored logs: recordings, mirrors, checkpoints."""

from __future__ import annotations

import io
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one all executors share; local runs and tests without one get a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-"))
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_log(df: DataFrame, path: str, files: int = 4) -> str:
    """Write a log as files that come in its order, as a recorder leaves them."""
    df.repartitionByRange(files, "seq").sortWithinPartitions("seq").write.parquet(path)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def kept(spark: SparkSession, df: DataFrame, name: str, *made: str) -> DataFrame:
    """A result written to a folder of its own, so that the folders it was made from can go."""
    path = folder(spark, name)
    df.write.parquet(path)
    drop(spark, *made)
    return spark.read.schema(df.schema).parquet(path)


class Recorder:
    """Rows noted on the driver as they come, and written to a shared folder part by part, so that it never holds more than one part.

    A part goes out with 50,000 rows, or with 16 million characters.
    """

    ROWS, CHARACTERS = 50_000, 16_000_000

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.path, self.schema = spark, folder(spark, name), StructType.fromDDL(schema)
        self.rows, self.characters, self.count, self.parts = [], 0, 0, 0

    def put(self, *row) -> None:
        self.rows.append(row)
        self.count += 1
        for value in row:
            if isinstance(value, str):
                self.characters += len(value)
        if len(self.rows) >= self.ROWS or self.characters >= self.CHARACTERS:
            self._write()

    def _write(self) -> None:
        form = to_arrow_schema(self.schema)
        columns = zip(*self.rows) if self.rows else [()] * len(form)
        part = io.BytesIO()
        pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, form)], schema=form), part)
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/part-{self.parts:06d}.parquet")
        out = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p)
        try:
            out.write(part.getvalue())
        finally:
            out.close()
        self.rows, self.characters, self.parts = [], 0, self.parts + 1

    def frame(self) -> DataFrame:
        """All rows so far, in a frame that reads them where they were written."""
        if self.rows or not self.parts:
            self._write()
        return self.spark.read.schema(self.schema).parquet(self.path)
