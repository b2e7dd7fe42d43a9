"""Checks on mirrors and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checksum(mirror: DataFrame, key: str, line: Column) -> DataFrame:
    """(checksum): 'count:md5' of all lines in key order. Gathers the lines: for mirrors of a size to compare by eye."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, line.alias("s")))), lambda x: x["s"]), ",")
    return mirror.agg(F.count("*").alias("n"), lines.alias("l")).select(F.concat(F.col("n").cast("string"), F.lit(":"), F.md5("l")).alias("checksum"))


def fingerprint(mirror: DataFrame) -> DataFrame:
    """(n, total): row count and the sum of row hashes, by partial aggregation; equal mirrors have equal ones in any order."""
    return mirror.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*mirror.columns).cast("decimal(38,0)")).alias("total"))


def duplicates(delivered: DataFrame, keys: list[str]) -> DataFrame:
    return delivered.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")
