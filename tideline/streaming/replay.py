"""A stream that replays a change log kept as Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMA


def replay_stream(spark: SparkSession, path: str, start: int = 0, max_files: int = 16) -> DataFrame:
    """Events after seq `start`, at most max_files files a batch; files must come in the order of the log.

    seq is that of the log, so a replay gives an event the number it had. Files reach the
    stream through Spark's own source: any store it reads will do, and the filter goes down to the files.
    """
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path).where(F.col("seq") > start)
