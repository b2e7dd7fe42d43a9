"""Folding a change log into the current state of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DELETE, READ, TRUNCATE, UPSERTS, keys_for, qualified, row_key


def rekeyed(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The log with a delete of the old key before every update that changes the key."""
    old, new = row_key(keys, "before"), row_key(keys, "after")
    moved = log.where((F.col("op") == "u") & old.isNotNull() & new.isNotNull() & (old != new))
    gone = moved.withColumn("op", F.lit(DELETE)).withColumn("after", F.lit(None).cast("map<string,string>"))
    return log.unionByName(gone)


def apply_changes(log: DataFrame, keys: Sequence[str], columns: Mapping[str, str], soft_delete: bool = False, deleted_column: str = "_deleted_at", rekey: bool = False) -> DataFrame:
    """State of one table after its whole log: key columns, the other columns with their types, last_seq.

    columns: column -> Spark type, keys included. The result depends on the set of events,
    not on their order or number of copies. A column keeps the last value sent, so one
    that an event leaves out is not overwritten, while an explicit NULL is. A delete or truncate blanks the row; what comes later starts anew. With
    soft_delete it stamps the row with its commit time instead, values stay, and a later
    upsert clears the stamp. An update that changes the key leaves the old row unless
    rekey is set. Events are taken as valid: see violations().

    One partial aggregation on the key; the truncate fence is a single row, and with soft_delete the truncates
    are met by log number.
    """
    if rekey:
        log = rekeyed(log, keys)
    up = F.col("op").isin(*UPSERTS)
    key = F.when(up, row_key(keys, "after")).otherwise(row_key(keys, "before"))
    truncates = log.where(F.col("op") == TRUNCATE)
    fences = truncates.agg(F.max("seq").alias("fence"))
    rows = log.where((F.col("op") != TRUNCATE) & key.isNotNull()).select("seq", "op", "commit_ts", key.alias("k"), "after")
    rest = [c for c in columns if c not in keys]
    sent = lambda c: up & F.map_contains_key("after", F.lit(c))
    folded = rows.groupBy("k").agg(
        F.max(F.when(up, F.col("seq"))).alias("last_seq"),
        F.max(F.when(~up, F.struct("seq", "commit_ts"))).alias("gone"),
        *[F.max(F.when(sent(c), F.struct(F.col("seq"), F.col("after")[c].alias("v")))).alias(f"c_{i}") for i, c in enumerate(rest)],
    )
    state = folded.where(F.col("last_seq").isNotNull())
    if soft_delete:
        ended = first_after(state, truncates.select("seq", "commit_ts"))
        stamp = F.when(F.col("gone.seq") > F.col("last_seq"), F.col("gone.commit_ts")).otherwise(F.col("_next.commit_ts"))
        state, value = ended, lambda c: F.col(f"{c}.v")
    else:
        reset = F.greatest(F.coalesce("gone.seq", F.lit(-1)), F.coalesce("fence", F.lit(-1)))
        state = state.crossJoin(F.broadcast(fences)).where(F.col("last_seq") > reset)
        value = lambda c: F.when(F.col(f"{c}.seq") > reset, F.col(f"{c}.v"))
    out = state.select(
        *[F.col(f"k.{k}").cast(columns[k]).alias(k) for k in keys],
        *[value(f"c_{i}").cast(columns[c]).alias(c) for i, c in enumerate(rest)],
        "last_seq",
        *([stamp.alias(deleted_column)] if soft_delete else []),
    )
    return out


#: Ranges of log numbers that marks are dealt into, and marks up to which they are broadcast.
RANGES, FEW_MARKS = 4096, 100_000


def first_after(rows: DataFrame, marks: DataFrame, at: str = "last_seq") -> DataFrame:
    """rows with _next (seq, commit_ts): the first mark numbered above `at`, or null.

    Marks are dealt into at most RANGES ranges of log numbers. A row looks through those of its own
    range, which it meets by an equi-join, and then at the first mark of every later range, an array of
    at most RANGES entries, which alone is always broadcast.
    """
    n, low, high = marks.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
    if not n:
        return rows.withColumn("_next", F.lit(None).cast("struct<seq: bigint, commit_ts: timestamp>"))
    step = -(-(high - low + 1) // RANGES)
    range_ = lambda c: F.floor((c - low) / step)
    own = marks.groupBy(range_(F.col("seq")).alias("_range")).agg(F.array_sort(F.collect_set(F.struct("seq", "commit_ts"))).alias("_own"))
    heads = own.agg(F.array_sort(F.collect_list(F.get("_own", F.lit(0)))).alias("_heads"))
    first = lambda array: F.get(F.filter(array, lambda m: m["seq"] > F.col(at)), F.lit(0))
    met = rows.withColumn("_at", F.greatest(range_(F.col(at)), F.lit(0))).join(F.broadcast(own) if n <= FEW_MARKS else own, F.col("_at") == F.col("_range"), "left")
    return met.crossJoin(F.broadcast(heads)).withColumn("_next", F.coalesce(first("_own"), first("_heads"))).drop("_at", "_range", "_own", "_heads")


def image_state(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key struct of texts, image, last_seq): a table's rows after its log, whatever columns it has.

    The rules of apply_changes, without declared columns or types: each column of an image is an
    entry of its own, so both aggregations are partial and the second keeps the partitioning of the first.
    """
    up = F.col("op").isin(*UPSERTS)
    key = F.when(up, row_key(keys, "after")).otherwise(row_key(keys, "before"))
    rows = log.where((F.col("op") != TRUNCATE) & key.isNotNull()).select("seq", "op", "after", key.alias("key"))
    fence = log.where(F.col("op") == TRUNCATE).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("fence"))
    # A row's own numbers travel as the entry without a name.
    mark = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    entries = F.when(F.col("op").isin(*UPSERTS), F.concat(F.map_entries("after"), F.array(mark))).otherwise(F.array(mark))
    cells = rows.withColumn("e", F.explode(entries)).groupBy("key", F.col("e.key").alias("c")).agg(F.max(F.struct("seq", "e.value")).alias("last"), F.max(F.when(F.col("op") != DELETE, F.col("seq"))).alias("up"), F.max(F.when(F.col("op") == DELETE, F.col("seq"))).alias("gone"))
    whole = cells.groupBy("key").agg(F.max("up").alias("last_seq"), F.max("gone").alias("gone"), F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "last"))).alias("cells"))
    reset = F.greatest(F.coalesce("gone", F.lit(-1)), "fence")
    live = whole.crossJoin(F.broadcast(fence)).where(F.col("last_seq") > reset)
    kept = F.filter("cells", lambda x: x["last"]["seq"] > reset)
    return live.select("key", F.map_from_entries(F.transform(kept, lambda x: F.struct(x["c"].alias("key"), x["last"]["value"].alias("value")))).alias("image"), "last_seq")


def read_events(state: DataFrame, source_id: str, schema: str, table: str, position: str, seq: int) -> DataFrame:
    """Rows of image_state as read events at a consistent point; commit_ts is null."""
    return state.select(F.lit(seq).cast("long").alias("seq"), F.lit(source_id).alias("source_id"), F.lit(schema).alias("schema"), F.lit(table).alias("table"), F.lit(READ).alias("op"), F.lit(None).cast("map<string,string>").alias("before"), F.col("image").alias("after"), F.lit(position).alias("position"), F.lit(None).cast("timestamp").alias("commit_ts"))


def violations(keys: Mapping[str, Sequence[str]], schemas: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Why an event can't be applied, or null.

    Refused: an unknown op, a table without keys (a truncate needs none), an upsert
    without image or key, a delete without image or key, and, if the table's columns
    are given, a column it doesn't have.
    """
    cols, op, q = keys_for(keys), F.col("op"), qualified()
    missing = lambda m: F.filter(cols, lambda k: ~F.map_contains_key(m, k))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    first = lambda a: F.get(a, F.lit(0))
    out = (
        F.when(op == TRUNCATE, None)
        .when(~op.isin(*UPSERTS, DELETE), F.concat(F.lit("unknown op "), op))
        .when(empty(cols), F.concat(F.lit("no key columns for "), q))
        .when((op == DELETE) & empty("before"), F.concat(F.lit("delete on "), q, F.lit(" has no before image")))
        .when((op == DELETE) & (F.size(missing(F.col("before"))) > 0), F.concat(F.lit("delete on "), q, F.lit(" is missing key column "), first(missing(F.col("before")))))
        .when((op != DELETE) & empty("after"), F.concat(op, F.lit(" event on "), q, F.lit(" has no after image")))
        .when((op != DELETE) & (F.size(missing(F.col("after"))) > 0), F.concat(op, F.lit(" on "), q, F.lit(" is missing key column "), first(missing(F.col("after")))))
    )
    if schemas:
        known = F.create_map(*[x for k, v in schemas.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        extra = F.array_sort(F.array_except(F.map_keys("after"), F.try_element_at(known, q)))
        out = F.coalesce(out, F.when((op != DELETE) & (F.size(extra) > 0), F.concat(F.lit("column "), first(extra), F.lit(" of "), q, F.lit(" does not exist"))))
    return out


def snapshot_events(state: DataFrame, keys: Sequence[str], source_id: str, schema: str, table: str, position: str, seq: int | Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of a table as read events at a consistent point, or each at a log number of its own; commit_ts is null."""
    cols = columns or [c for c in state.columns if c != "last_seq"]
    after = F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*[F.col(c).cast("string") for c in cols]))
    return state.select(F.lit(seq).cast("long").alias("seq"), F.lit(source_id).alias("source_id"), F.lit(schema).alias("schema"), F.lit(table).alias("table"), F.lit(READ).alias("op"), F.lit(None).cast("map<string,string>").alias("before"), after.alias("after"), F.lit(position).alias("position"), F.lit(None).cast("timestamp").alias("commit_ts"))
