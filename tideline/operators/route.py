"""Fan-out, batches, cursors, envelopes and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import json_event
from ..model import idempotency_key, qualified


def fan_out(log: DataFrame, sinks: list[str]) -> DataFrame:
    """Every event once per sink, in the order of seq within each; a map without shuffle."""
    return log.withColumn("sink", F.explode(F.array(*map(F.lit, sinks))))


def batches(log: DataFrame, max_events: int, max_wait: str | None = None) -> DataFrame:
    """log with batch (struct window, number): at most max_events events, of one window of max_wait.

    Windows stand on the clock, not on a batch's first event, so that a replay makes the
    same batches. Without max_wait seq alone decides, and no shuffle is needed.
    """
    if max_wait is None:
        return log.withColumn("batch", F.struct(F.lit(None).cast("timestamp").alias("window"), F.floor((F.col("seq") - 1) / max_events).alias("number")))
    w = F.window("commit_ts", max_wait)["start"]
    rank = F.row_number().over(Window.partitionBy("_w").orderBy("seq"))
    return log.withColumn("_w", w).withColumn("batch", F.struct(F.col("_w").alias("window"), F.floor((rank - 1) / max_events).alias("number"))).drop("_w")


def envelopes(log: DataFrame, by: list[str], payload: Column) -> DataFrame:
    """One request per batch: source_id, count, first and last position, batch id, and the events in order as a JSON array."""
    first, last = F.min_by("position", "seq"), F.max_by("position", "seq")
    g = log.withColumn("_p", payload).groupBy(*by, "source_id").agg(F.count("*").alias("count"), first.alias("first_position"), last.alias("last_position"), F.array_sort(F.collect_list(F.struct("seq", "_p"))).alias("_e"))
    body = F.concat(F.lit("["), F.array_join(F.transform("_e", lambda e: e["_p"]), ","), F.lit("]"))
    return g.withColumn("batch_id", F.concat_ws("|", "source_id", "first_position", "last_position")).withColumn("events", body).drop("_e")


def retry_delays(failures: Column, initial_ms: int = 250, max_ms: int = 30_000) -> Column:
    """Wait after the k-th failure: doubled each time up to the limit."""
    return F.least(F.lit(max_ms).cast("double"), F.lit(initial_ms) * F.pow(F.lit(2.0), failures - 1)).cast("long")


def quarantine(log: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(deliverable, parked with a reason)."""
    judged = log.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def dead_letters(parked: DataFrame, pipeline_id: str, sink: str, attempts: int) -> DataFrame:
    return parked.select(F.lit(pipeline_id).alias("pipeline_id"), F.lit(sink).alias("sink_name"), "position", F.lit(attempts).alias("attempts"), F.col("reason").alias("error"), json_event().alias("event"))


def cursors(delivered: DataFrame) -> DataFrame:
    """(sink, position, seq): how far each sink has come."""
    return delivered.groupBy("sink").agg(F.max_by("position", "seq").alias("position"), F.max("seq").alias("seq"))


def slowest(cursor: DataFrame, n_sinks: int) -> DataFrame:
    """(position, seq) that may be committed: the least cursor, once every sink has one above 0."""
    return cursor.agg(F.min_by("position", "seq").alias("position"), F.min("seq").alias("seq"), F.count(F.when(F.col("seq") > 0, 1)).alias("n")).where(F.col("n") == n_sinks).select("position", "seq")


def message_headers(prefix: str = "tideline", content_type: str = "application/json") -> Column:
    """Headers of a broker message as an array of (key, value)."""
    pairs = [(f"{prefix}-op", F.col("op")), (f"{prefix}-source", F.col("source_id")), (f"{prefix}-position", F.col("position")), ("idempotency-key", idempotency_key()), ("content-type", F.lit(content_type))]
    return F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])


def op_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(qualified().alias("qualified"), "op").agg(F.count("*").alias("events"))
