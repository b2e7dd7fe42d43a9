"""Queries on snapshots and their boundary with the live log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apply, snapshot
from ..sources.changelog import COLUMNS, KEYS, SCHEMA, SOURCE, TABLE, change_log
from .registry import LOG, STATE, query
from .scratch import folder

KEY = KEYS["public.users"]
HALF = "(select count(*) // 2 from events)"
AT_HALF = STATE.format(upto=f"seq <= {HALF}")
ALL = STATE.format(upto="true")
#: Chunks: rows a page, and log positions between pages, from a low mark to the read, and to the high mark.
SIZE, SPACING, READ, HIGH = 5, 200, 50, 100

PLAN = f"""p as (select count(*) // 4 as p from events), ids as (select distinct id from log where op <> 't'),
  plan as (select id, (dense_rank() over (order by id) - 1) // {SIZE} as chunk from ids),
  marks as (select id, chunk, p + {SPACING} * chunk as lw, p + {SPACING} * chunk + {READ} as read_seq, p + {SPACING} * chunk + {HIGH} as hw from plan, p),
  ev as (select l.*, m.chunk, m.lw, m.read_seq, m.hw from log l join marks m using (id) where l.op <> 't' and l.seq <= m.read_seq),
  fenced as (select e.* from ev e where e.seq > coalesce((select max(seq) from log t where t.op = 't' and t.seq <= e.read_seq), -1)),
  page as (select id, chunk, lw, hw, max(seq) filter (op <> 'd') as last_seq from fenced group by id, chunk, lw, hw
    having max(seq) filter (op <> 'd') > coalesce(max(seq) filter (op = 'd'), -1)),
  touched as (select distinct m.chunk, m.id from log l join marks m using (id) where l.op <> 't' and l.seq > m.lw and l.seq <= m.hw),
  cut as (select distinct m.chunk from log l join (select distinct chunk, lw, hw from marks) m on l.op = 't' and l.seq > m.lw and l.seq <= m.hw)"""


def _half(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").count() // 2


def _snapshot(spark: SparkSession, sf_dir: str, at: int) -> DataFrame:
    state = apply.apply_changes(change_log(spark, sf_dir).where(F.col("seq") <= at), KEY, COLUMNS)
    return snapshot_events(state, at)


def snapshot_events(state: DataFrame, at: int) -> DataFrame:
    return apply.snapshot_events(state, KEY, SOURCE, SCHEMA, TABLE, f"0/{at:04X}", at)


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks over all ids that the log ever names; reads start at a quarter of it."""
    log = change_log(spark, sf_dir)
    start = spark.read.parquet(f"{sf_dir}/events.parquet").count() // 4
    ids = log.where("op <> 't'").select(F.coalesce(F.col("after")["id"], F.col("before")["id"]).cast("bigint").alias("id"))
    return snapshot.chunk_plan(ids, "id", SIZE, start, SPACING, READ, HIGH, F.floor(F.col("id") / 4096))


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, plan, rows of the chunks); the plan is written once, as a snapshot's plan is."""
    log, path = change_log(spark, sf_dir), folder(spark, "plan")
    _plan(spark, sf_dir).write.parquet(path)
    plan = spark.read.parquet(path)
    return log, plan, snapshot.read_chunks(log, plan, KEY, COLUMNS, apply.apply_changes)


@query(f"with {LOG}, {AT_HALF} select id, kind, value, props, 'r' as op, printf('0/%04X', {HALF}) as position from state")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _snapshot(spark, sf_dir, _half(spark, sf_dir))
    return r.select(*[F.col("after")[c].cast(t).alias(c) for c, t in COLUMNS.items()], "op", "position")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Event numbers that each side of the cut delivers; the stream side starts three events early for the overlap."""
    log, half = change_log(spark, sf_dir), _half(spark, sf_dir)
    return log.select("seq"), log.where(F.col("seq") <= half).select("seq"), log.where(F.col("seq") > half).select("seq")


@query(f"with {LOG} select 'gap' as kind, seq from log where seq > {HALF} and seq <= {HALF} + 2")
def snapshot_stream_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream that starts two events late never delivers."""
    every, before, after = _sides(spark, sf_dir)
    late = after.where(F.col("seq") > _half(spark, sf_dir) + 2)
    return snapshot.boundary(before, late, every, "seq").where("kind = 'gap'")


@query(f"with {LOG} select 'overlap' as kind, seq from log where seq > {HALF} - 3 and seq <= {HALF}")
def snapshot_stream_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream that starts three events early delivers twice."""
    every, before, _ = _sides(spark, sf_dir)
    early = every.where(F.col("seq") > _half(spark, sf_dir) - 3)
    return snapshot.boundary(before, early, every, "seq").where("kind = 'overlap'")


@query(f"with {LOG}, {ALL} select id, kind, value, props from state")
def snapshot_union_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot at the cut and the stream after it give the state of the whole log."""
    half = _half(spark, sf_dir)
    both = _snapshot(spark, sf_dir, half).unionByName(change_log(spark, sf_dir).where(F.col("seq") > half))
    return apply.apply_changes(both, KEY, COLUMNS).drop("last_seq")


@query(f"with {LOG}, {ALL} select id, kind, value, props from state")
def boundary_duplicates_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that starts before the snapshot delivers events again; the fold absorbs them."""
    half = _half(spark, sf_dir)
    both = _snapshot(spark, sf_dir, half).unionByName(change_log(spark, sf_dir).where(F.col("seq") > half // 2))
    return apply.apply_changes(both, KEY, COLUMNS).drop("last_seq")


@query(f"with {LOG}, {PLAN} select chunk, id, last_seq from page")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir)[2].select("chunk", "id", "last_seq")


@query(f"with {LOG}, {PLAN} select chunk, id from touched")
def chunk_observed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.observed(change_log(spark, sf_dir), _plan(spark, sf_dir), "id", "bigint")


@query(f"with {LOG}, {PLAN} select chunk, id from page where (chunk, id) in (select (chunk, id) from touched) or chunk in (select chunk from cut)")
def chunk_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, plan, pages = _pages(spark, sf_dir)
    return snapshot.superseded(log, plan, pages, "id", "bigint").select("chunk", "id")


@query(f"with {LOG}, {PLAN} select chunk, count(*) as n_keys, min(id) as first_id, max(id) as last_id from marks where chunk > 2 group by chunk")
def chunk_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after chunk 2 was accepted."""
    left = snapshot.resume_after(_plan(spark, sf_dir), 2)
    return left.groupBy("chunk").agg(F.count("*").alias("n_keys"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"with {LOG}, {PLAN}, {ALL} select s.id, s.id in (select id from page) as by_chunk, exists (select 1 from log l, p where l.id = s.id and l.op in ('c','u') and l.seq > p) as by_stream from state s")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side delivers each row that is alive at the end; one of them must."""
    log, plan, pages = _pages(spark, sf_dir)
    start = spark.read.parquet(f"{sf_dir}/events.parquet").count() // 4
    ids = lambda d, name: d.select("id").distinct().withColumn(name, F.lit(True))
    stream = log.where((F.col("seq") > start) & F.col("op").isin("c", "u")).select(F.col("after")["id"].cast("bigint").alias("id"))
    alive = apply.apply_changes(log, KEY, COLUMNS).select("id")
    return alive.join(ids(pages, "c"), "id", "left").join(ids(stream, "s"), "id", "left").select("id", F.coalesce("c", F.lit(False)).alias("by_chunk"), F.coalesce("s", F.lit(False)).alias("by_stream"))


@query(f"with {LOG}, {ALL} select id, kind, value, props from state")
def chunk_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows at their marks and the stream from the consistent point give the state of the whole log."""
    log, plan, pages = _pages(spark, sf_dir)
    start = spark.read.parquet(f"{sf_dir}/events.parquet").count() // 4
    placed = snapshot.place_rows(log, plan, pages, "id", "bigint")
    rows = apply.snapshot_events(placed, KEY, SOURCE, SCHEMA, TABLE, "", F.col("at"), list(COLUMNS))
    return apply.apply_changes(rows.unionByName(log.where(F.col("seq") > start)), KEY, COLUMNS).drop("last_seq")


@query("""with c as (select distinct 'public.' || lower(o_orderpriority[1:1]) as "table" from orders union select 'public.users'), p as (select distinct 'public.' || event_type as "table" from events union select 'public.users')
  select "table", case when p."table" is null then 'missing' when c."table" is null then 'extra' else 'ok' end as status from c full outer join p using ("table")""")
def publication_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.createDataFrame([("public.users",)], "`table` string")
    configured = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("public."), F.lower(F.substring("o_orderpriority", 1, 1))).alias("table")).distinct().union(users)
    captured = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("public."), "event_type").alias("table")).distinct().union(users)
    return snapshot.publication_drift(configured, captured)
