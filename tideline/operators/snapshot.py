"""Initial snapshots in chunks, reconciled with the live log by low and high watermarks.

A plan has one row a key: chunk, the key columns, and the log numbers lw, read_seq and hw of the
chunk's low mark, of its read and of its high mark. Keys may have several columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import TRUNCATE, row_key

#: Chunks up to which their marks are broadcast; beyond that, log numbers to a range that windows are listed in, and ranges that points are dealt into.
FEW_CHUNKS, RANGE, RANGES = 2_000, 1 << 16, 4096


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def dense_rank(df: DataFrame, key: str | Sequence[str], bucket: Column, name: str = "rank") -> DataFrame:
    """Rank from 0 of distinct keys, without a global sort.

    bucket must rise with the key. Keys are ranked inside buckets and shifted by the
    count of those before. The shifts are summed in two steps, inside groups of 4096 buckets and
    over groups, so no task holds more than that many counts or one a group.
    """
    keys = _keys(key)
    d = df.select(*keys).distinct().withColumn("_b", bucket)
    counts = d.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_g", F.floor(F.col("_b") / 4096))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_g").agg(F.sum("_n").alias("_gn")).select("_g", F.coalesce(F.sum("_gn").over(before("_g")), F.lit(0)).alias("_gs"))
    shift = counts.withColumn("_in", F.coalesce(F.sum("_n").over(before("_g", "_b")), F.lit(0))).join(groups, "_g").select("_b", (F.col("_in") + F.col("_gs")).alias("_s"))
    inside = d.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*keys)))
    return inside.join(shift, "_b").select(*keys, (F.col("_r") - 1 + F.col("_s")).alias(name))


def chunk_plan(ids: DataFrame, key: str | Sequence[str], size: int, start: int, spacing: int, read_after: int, high_after: int, bucket: Column) -> DataFrame:
    """A plan of pages of `size` keys in order, whose marks stand at fixed steps in the log.

    Pages are key ranges fixed beforehand, so all of them can be read at once; a key
    that appears later reaches the sink through the log.
    """
    page = F.floor(F.col("rank") / size).cast("long")
    lw = F.lit(start) + page * spacing
    return dense_rank(ids, key, bucket).select(page.alias("chunk"), *_keys(key), lw.alias("lw"), (lw + read_after).alias("read_seq"), (lw + high_after).alias("hw"))


def marks(log: DataFrame, prefix: str) -> DataFrame:
    """(chunk, lw, hw) of the marks that came back in the log (op 'w'; after: prefix, kind low or high, chunk).

    Marks of another prefix are someone else's. A chunk that was begun anew counts from its last low mark, and
    by the first high mark after that; a high mark without a low one, and a low one that no high one follows, are left out.
    """
    w = log.where(F.col("op") == "w").select("seq", *[F.col("after")[k].alias(k) for k in ("prefix", "kind", "chunk")]).where(F.col("prefix") == prefix)
    lows = w.where("kind = 'low'").groupBy("chunk").agg(F.max("seq").alias("lw"))
    highs = w.where("kind = 'high'").select("chunk", "seq")
    return lows.join(highs, "chunk").where(F.col("seq") > F.col("lw")).groupBy(F.col("chunk").cast("long").alias("chunk"), "lw").agg(F.min("seq").alias("hw"))


def without_marks(log: DataFrame) -> DataFrame:
    """The log as sinks see it."""
    return log.where(F.col("op") != "w")


def keyless(tables: DataFrame) -> DataFrame:
    """(schema, table) of tables without key columns, which can't be read in chunks."""
    return tables.where(F.coalesce(F.size("keys"), F.lit(0)) <= 0).select("schema", "table")


def keyset_page(state: DataFrame, keys: Sequence[str], after: Sequence | None, size: int) -> DataFrame:
    """The next `size` rows in key order after a key, for one step of a resumable walk."""
    if after is not None:
        kinds = [f.dataType for f in state.select(*keys).schema.fields]
        state = state.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(t) for v, t in zip(after, kinds)]))
    return state.orderBy(*keys).limit(size)


def _key_of(keys: Sequence[str], kinds: Mapping[str, str], image: str) -> list[Column]:
    return [F.col(image)[k].cast(kinds[k]).alias(k) for k in keys]


def _in_windows(points: DataFrame, windows: DataFrame, low: str | None, high: str) -> DataFrame:
    """points (seq) by the windows (chunk, low, high] that hold them; low None: from the beginning, and of many windows only the last point of each.

    Few windows are broadcast. More meet the points by ranges of log numbers: a window is listed in the ranges it touches.
    """
    bounds = windows.select("chunk", *([low] if low else []), high).distinct()
    if bounds.count() <= FEW_CHUNKS:
        inside = (F.col("seq") <= F.col(high)) & ((F.col("seq") > F.col(low)) if low else F.lit(True))
        return points.join(F.broadcast(bounds), inside)
    if low is None:
        return _last_before(points, bounds, high)
    spread = bounds.withColumn("_range", F.explode(F.sequence(F.floor(F.col(low) / RANGE), F.floor(F.col(high) / RANGE))))
    return points.withColumn("_range", F.floor(F.col("seq") / RANGE)).join(spread, "_range").where((F.col("seq") > F.col(low)) & (F.col("seq") <= F.col(high))).drop("_range")


def _last_before(points: DataFrame, bounds: DataFrame, high: str) -> DataFrame:
    """(chunk, high, seq): the last point up to each bound, where there is one.

    Points lie in at most RANGES ranges: a bound meets those of its own by an equi-join, and the last one of
    each range in an array that is broadcast.
    """
    least, most = points.agg(F.min("seq"), F.max("seq")).first()
    if least is None:
        return bounds.select("chunk", high, F.lit(None).cast("long").alias("seq")).limit(0)
    step = -(-(most - least + 1) // RANGES)
    range_ = lambda c: F.floor((c - least) / step)
    own = points.groupBy(range_(F.col("seq")).alias("_range")).agg(F.collect_set("seq").alias("_own"))
    tops = own.agg(F.collect_list(F.array_max("_own")).alias("_tops"))
    upto = lambda c: F.array_max(F.filter(c, lambda x: x <= F.col(high)))
    met = bounds.join(own, range_(F.col(high)) == F.col("_range"), "left").crossJoin(F.broadcast(tops))
    return met.select("chunk", high, F.coalesce(upto("_own"), upto("_tops")).alias("seq")).where("seq is not null")


def read_chunks(log: DataFrame, plan: DataFrame, keys: Sequence[str], columns: Mapping[str, str], apply) -> DataFrame:
    """Rows of every chunk as they stood at its read position: plan columns plus `columns`.

    One pass for all chunks: events up to a chunk's read position meet its keys by an
    equi-join, and truncates reach every chunk read after them.
    """
    keys = _keys(keys)
    of = [F.coalesce(F.col("after")[k], F.col("before")[k]).cast(columns[k]) for k in keys]
    rows = log.where(F.col("op") != TRUNCATE).withColumns({f"_k{i}": c for i, c in enumerate(of)})
    at = plan.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    rows = rows.join(at, [f"_k{i}" for i in range(len(keys))]).where(F.col("seq") <= F.col("read_seq"))
    truncates = log.where(F.col("op") == TRUNCATE).select("seq")
    if truncates.limit(1).count():
        fences = _in_windows(truncates, plan, None, "read_seq").groupBy("chunk").agg(F.max("seq").alias("fence"))
        rows = rows.join(F.broadcast(fences) if fences.count() <= FEW_CHUNKS else fences, "chunk", "left").where(F.col("seq") > F.coalesce("fence", F.lit(-1))).drop("fence")
    state = apply(rows.drop("lw", "read_seq", "hw", "chunk"), keys, columns)
    return state.join(plan, keys)


def observed(log: DataFrame, plan: DataFrame, key: str | Sequence[str], kind: str | Mapping[str, str]) -> DataFrame:
    """(chunk, key columns): keys of a chunk that the log touches between its marks, by either image."""
    keys = _keys(key)
    kinds = {keys[0]: kind} if isinstance(kind, str) else kind
    rows = log.where(F.col("op") != TRUNCATE)
    image = lambda name: F.when(row_key(keys, name).isNotNull(), F.struct(*_key_of(keys, kinds, name)))
    both = rows.select("seq", F.explode(F.array_distinct(F.array_compact(F.array(image("before"), image("after"))))).alias("_k")).select("seq", "_k.*")
    hits = both.join(plan, keys).where((F.col("seq") > F.col("lw")) & (F.col("seq") <= F.col("hw")))
    return hits.select("chunk", *keys).distinct()


def truncated(log: DataFrame, plan: DataFrame) -> DataFrame:
    """(chunk): chunks with a truncate between their marks; all their rows are superseded."""
    return _in_windows(log.where(F.col("op") == TRUNCATE).select("seq"), plan, "lw", "hw").select("chunk").distinct()


def _touched(log: DataFrame, plan: DataFrame, chunk_rows: DataFrame, key: str | Sequence[str], kind: str | Mapping[str, str]) -> DataFrame:
    """chunk_rows with _hit: whether the log changes the row between the chunk's marks."""
    seen = observed(log, plan, key, kind).withColumn("_t", F.lit(True))
    whole = truncated(log, plan).withColumn("_w", F.lit(True))
    d = chunk_rows.join(seen, ["chunk", *_keys(key)], "left").join(whole, "chunk", "left")
    return d.withColumn("_hit", F.coalesce("_t", "_w", F.lit(False))).drop("_t", "_w")


def superseded(log: DataFrame, plan: DataFrame, chunk_rows: DataFrame, key: str | Sequence[str], kind: str | Mapping[str, str]) -> DataFrame:
    """Rows of chunks that the log changes between the marks."""
    return _touched(log, plan, chunk_rows, key, kind).where("_hit").drop("_hit")


def place_rows(log: DataFrame, plan: DataFrame, chunk_rows: DataFrame, key: str | Sequence[str], kind: str | Mapping[str, str], parity: bool = False) -> DataFrame:
    """chunk_rows with the position `at` they take in the log.

    Untouched rows stand at the high mark. Touched ones stand at the low mark, below the
    window's events, so that a column those leave out keeps its value; with parity they
    are dropped instead, which is right only for full images.
    """
    d = _touched(log, plan, chunk_rows, key, kind)
    if parity:
        d = d.where(~F.col("_hit"))
    return d.withColumn("at", F.when(F.col("_hit"), F.col("lw")).otherwise(F.col("hw"))).drop("_hit")


def resume_after(plan: DataFrame, chunk: int) -> DataFrame:
    """What is left of a plan when `chunk` was the last one accepted by all sinks."""
    return plan.where(F.col("chunk") > chunk)


def resume_after_key(ids: DataFrame, keys: Sequence[str], after: Sequence[str]) -> DataFrame:
    """Keys that a snapshot has still to read after the last accepted one, given as texts and compared by the columns' own types.

    It asks for no number of a chunk, so keys that came or went since change nothing.
    """
    kinds = dict(ids.dtypes)
    return ids.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(keys, after)]))


def publication_drift(configured: DataFrame, captured: DataFrame) -> DataFrame:
    """(table, status): missing if configured but not captured (an error), extra if captured only (a warning), else ok."""
    c, p = configured.select("table").distinct().withColumn("c", F.lit(True)), captured.select("table").distinct().withColumn("p", F.lit(True))
    return c.join(p, "table", "full_outer").select("table", F.when(F.col("p").isNull(), "missing").when(F.col("c").isNull(), "extra").otherwise("ok").alias("status"))


def boundary(snapshot_keys: DataFrame, stream_keys: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(kind, key): keys expected but delivered by neither side (gap), and delivered by both (overlap)."""
    delivered = snapshot_keys.select(key).unionByName(stream_keys.select(key)).distinct()
    gap = expected.select(key).join(delivered, key, "left_anti").select(F.lit("gap").alias("kind"), key)
    overlap = snapshot_keys.select(key).intersect(stream_keys.select(key)).select(F.lit("overlap").alias("kind"), key)
    return gap.unionByName(overlap)


def of_key(keys: Sequence[str]) -> Column:
    return F.coalesce(row_key(keys, "after"), row_key(keys, "before"))
