"""A deterministic change log made from the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = {"public.users": ["id"]}
COLUMNS = {"id": "bigint", "kind": "string", "value": "double", "props": "string"}
NUMBERS = ("id", "value")
SOURCE, SCHEMA, TABLE = "pg-main", "public", "users"


def operation() -> Column:
    """signup inserts, error deletes, other events update; one event in 7919 truncates."""
    return F.when(F.col("event_id") % 7919 == 500, "t").when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")


def after_image() -> Column:
    """id, kind, value and props as text: a click sends an explicit NULL value, a view leaves props out."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    base = [pair("id", F.col("user_id")), pair("kind", F.col("event_type")), pair("value", F.when(F.col("event_type") != "click", F.col("value").cast("decimal(10,2)")))]
    return F.map_from_entries(F.when(F.col("event_type") == "view", F.array(*base)).otherwise(F.array(*base, pair("props", F.col("props")))))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of public.users: seq, source_id, schema, table, op, before, after, position, commit_ts. A map, no shuffle."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("op", operation())
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.lit(SOURCE).alias("source_id"),
        F.lit(SCHEMA).alias("schema"),
        F.lit(TABLE).alias("table"),
        "op",
        F.when(F.col("op") == "d", F.create_map(F.lit("id"), F.col("user_id").cast("string"))).alias("before"),
        F.when(F.col("op").isin("c", "u"), after_image()).alias("after"),
        F.format_string("0/%04X", F.col("event_id") + 1).alias("position"),
        F.col("ts").cast("timestamp").alias("commit_ts"),
    )
