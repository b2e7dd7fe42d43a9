"""Queries that fold a change log into state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apply, route, verify
from ..sources.changelog import COLUMNS, KEYS, NUMBERS, change_log
from ..functions.encoding import json_event
from .registry import EVENT, LOG, STATE, query

KEY = KEYS["public.users"]
ALL = STATE.format(upto="true")
SOFT = """up as (select * from log where op in ('c','u')), last as (select id, max(seq) as last_seq from up group by id),
  vals as (select id, arg_max(kind, seq) as kind,
    (select value from up a where a.id = u.id order by seq desc limit 1)::double as value,
    (select props from up a where a.id = u.id and has_props order by seq desc limit 1) as props from up u group by id)"""


@query(f"with {LOG}, {ALL} select id, kind, value, props, last_seq from state")
def materialize_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.apply_changes(change_log(spark, sf_dir), KEY, COLUMNS)


@query(f"with {LOG}, {ALL} select id, kind, value, props, last_seq from state")
def replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    return apply.apply_changes(log.unionByName(log), KEY, COLUMNS)


@query(f"""with {LOG}, {SOFT}
  select l.id, v.kind, v.value, v.props, l.last_seq,
    coalesce((select arg_max(commit_ts, seq) from log d where d.op = 'd' and d.id = l.id and d.seq > l.last_seq),
             (select arg_min(commit_ts, seq) from log t where t.op = 't' and t.seq > l.last_seq)) as deleted_at
  from last l join vals v using (id)""")
def materialize_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = apply.apply_changes(change_log(spark, sf_dir), KEY, COLUMNS, soft_delete=True, deleted_column="deleted_at")
    return s.withColumn("deleted_at", F.col("deleted_at").cast("timestamp_ntz"))


@query(f"with {LOG}, {SOFT} select id, last_seq from last where not exists (select 1 from log d where d.seq > last_seq and (d.op = 't' or (d.op = 'd' and d.id = last.id))) and exists (select 1 from log d where d.seq < last_seq and (d.op = 't' or (d.op = 'd' and d.id = last.id)))")
def revived_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were deleted and came back: their stamp is cleared."""
    log = change_log(spark, sf_dir)
    soft = apply.apply_changes(log, KEY, COLUMNS, soft_delete=True).where("_deleted_at is null")
    gone = log.where("op = 'd'").groupBy(F.col("before")["id"].cast("bigint").alias("id")).agg(F.min("seq").alias("d"))
    fence = log.where("op = 't'").agg(F.min("seq").alias("t"))
    d = soft.join(gone, "id", "left").crossJoin(F.broadcast(fence))
    return d.where((F.col("d") < F.col("last_seq")) | (F.col("t") < F.col("last_seq"))).select("id", "last_seq")


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log, in which every seventh purchase moves its row to another key."""
    log = change_log(spark, sf_dir)
    moved = (F.col("op") == "u") & (F.col("after")["kind"] == "purchase") & (F.col("seq") % 7 == 0)
    to = F.transform_values("after", lambda k, v: F.when(k == "id", (v.cast("bigint") + 1000000).cast("string")).otherwise(v))
    return log.withColumn("before", F.when(moved, F.create_map(F.lit("id"), F.col("after")["id"])).otherwise(F.col("before"))).withColumn("after", F.when(moved, to).otherwise(F.col("after")))


MOVES = f"""{LOG}, moved as (select *, op = 'u' and kind = 'purchase' and seq % 7 = 0 as m from log),
  ups as (select seq, case when m then id + 1000000 else id end as id from moved where op in ('c','u')),
  dels as (select seq, id from moved where op = 'd' {{extra}}), t as (select coalesce(max(seq), -1) as t from log where op = 't')
  select id, max(seq) as last_seq from ups where seq > (select t from t) group by id
  having max(seq) > coalesce((select max(seq) from dels d where d.id = ups.id), -1)"""


@query("with " + MOVES.format(extra=" or m"))
def rekey_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.apply_changes(_moves(spark, sf_dir), KEY, COLUMNS, rekey=True).select("id", "last_seq")


@query("with " + MOVES.format(extra=""))
def rekey_leaves_old_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without rekey the row under the old key stays."""
    return apply.apply_changes(_moves(spark, sf_dir), KEY, COLUMNS).select("id", "last_seq")


@query(f"with {LOG}, {ALL} select id, last_seq, kind from state")
def key_only_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nothing but the key insert a row where there is none and change no value elsewhere."""
    log = change_log(spark, sf_dir)
    bare = log.where("op in ('c','u')").withColumn("after", F.map_filter("after", lambda k, v: k == "id"))
    return apply.apply_changes(log.unionByName(bare), KEY, COLUMNS).select("id", "last_seq", "kind")


def poisoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with events that can't be applied."""
    log = change_log(spark, sf_dir)
    s = F.col("seq")
    no_key = F.map_filter("after", lambda k, v: k != "id")
    extra = F.map_concat("after", F.create_map(F.lit("ghost"), F.lit("1")))
    empty = F.map_filter("after", lambda k, v: F.lit(False))
    after = F.when(s % 101 == 0, no_key).when(s % 103 == 0, empty).when(s % 109 == 0, extra).otherwise(F.col("after"))
    before = F.when(s % 107 == 0, F.lit(None)).otherwise(F.col("before"))
    return log.withColumn("after", after).withColumn("before", before).withColumn("table", F.when(s % 113 == 0, "orphans").otherwise(F.col("table")))


SCHEMAS = {"public.users": list(COLUMNS)}
POISON = """case when op = 't' then null when seq % 113 = 0 then 'no key columns for public.orphans'
  when op = 'd' and seq % 107 = 0 then 'delete on public.users has no before image'
  when op <> 'd' and seq % 101 = 0 then op || ' on public.users is missing key column id'
  when op <> 'd' and seq % 103 = 0 then op || ' event on public.users has no after image'
  when op <> 'd' and seq % 109 = 0 then 'column ghost of public.users does not exist' end"""


@query(f"with {LOG} select seq, op, {POISON} as reason from log where {POISON} is not null")
def poison_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisoned(spark, sf_dir).withColumn("reason", apply.violations(KEYS, SCHEMAS)).where("reason is not null").select("seq", "op", "reason")


@query(f"with {LOG} select (seq - 1) // 500 as batch, count(*) as events, count({POISON}) as parked, count(*) - count({POISON}) as delivered from log group by 1")
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = route.batches(poisoned(spark, sf_dir), 500).withColumn("reason", apply.violations(KEYS, SCHEMAS))
    return d.groupBy(F.col("batch.number").alias("batch")).agg(F.count("*").alias("events"), F.count("reason").alias("parked"), F.count(F.when(F.col("reason").isNull(), 1)).alias("delivered"))


@query(f"with {LOG} select 'users' as pipeline_id, 'mirror' as sink_name, position, 5 as attempts, {POISON} as error from log where {POISON} is not null")
def dead_letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parked = route.quarantine(poisoned(spark, sf_dir), apply.violations(KEYS, SCHEMAS))
    return route.dead_letters(parked, "users", "mirror", 5).drop("event")


@query(f"with {LOG} select count(*) as total, count(*) - count({POISON}) as delivered, count({POISON}) as parked, 0::bigint as lost from log")
def delivered_plus_parked(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = route.quarantine(poisoned(spark, sf_dir), apply.violations(KEYS, SCHEMAS))
    sides = good.select("seq", F.lit(1).alias("ok")).unionByName(bad.select("seq", F.lit(0).alias("ok")))
    a = sides.agg(F.sum("ok").alias("delivered"), F.sum(1 - F.col("ok")).alias("parked"), F.count("*").alias("n"))
    b = change_log(spark, sf_dir).agg(F.count("*").alias("total"))
    return a.crossJoin(b).select("total", "delivered", "parked", (F.col("total") - F.col("n")).alias("lost"))


@query(f"with {LOG} select seq, 'ghost' as col from log where op in ('c','u') and seq % 109 = 0 and seq % 101 <> 0 and seq % 103 <> 0 and seq % 113 <> 0")
def schema_drift_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a column the table doesn't have."""
    extra = F.array_except(F.map_keys("after"), F.array(*map(F.lit, COLUMNS)))
    return poisoned(spark, sf_dir).where("table = 'users'").select("seq", F.explode(extra).alias("col"))


@query(f"with {LOG}, {ALL} select count(*) || ':' || md5(string_agg(id || '|' || kind, ',' order by id)) as checksum from state")
def mirror_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.checksum(materialize_state(spark, sf_dir), "id", F.concat_ws("|", F.col("id").cast("string"), "kind"))


@query(f"with {LOG} select seq, {EVENT} as event from log")
def json_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_log(spark, sf_dir).select("seq", json_event(NUMBERS).alias("event"))
