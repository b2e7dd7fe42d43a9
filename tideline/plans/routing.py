"""Queries on routing, delivery and the names and messages made for sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.encoding import encode, json_event
from ..model import idempotency_key, qualified
from ..operators import route
from ..sources.changelog import KEYS, NUMBERS, change_log
from ..streaming.control import ControlStore
from ..streaming.delivery import Delivery, Policy, Router
from ..streaming.observe import Registry
from .registry import EVENT, LOG, query

SINKS = ["stdout", "mirror", "broker"]


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log spread over odd names, to see them cleaned."""
    log = change_log(spark, sf_dir)
    return log.withColumn("schema", F.element_at(F.array(*map(F.lit, ["", "public", "pub.lic", "Sales Eu"])), (F.col("seq") % 4 + 1).cast("int"))).withColumn("table", F.element_at(F.array(*map(F.lit, ["users", 'we"ird', "we>ird", "a*b c"])), (F.floor(F.col("seq") / 4) % 4 + 1).cast("int")))


TABLES = f"""{LOG}, odd as (select * replace (['', 'public', 'pub.lic', 'Sales Eu'][seq % 4 + 1] as "schema", ['users', 'we"ird', 'we>ird', 'a*b c'][(seq // 4) % 4 + 1] as "table") from log),
  named as (select *, case when "schema" = '' then "table" else "schema" || '.' || "table" end as q from odd)"""


@query(f"with {TABLES} select q as qualified, count(*) as events from named group by 1")
def qualified_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).groupBy(qualified().alias("qualified")).agg(F.count("*").alias("events"))


@query(f"""with {LOG}, k as (select source_id || '|public.users|' || printf('0/%04X', (seq - 1) // 100) as idempotency_key, id from log where op <> 't')
  select idempotency_key, count(*) as events, count(distinct id) as rows_lost_if_deduplicated from k group by 1 having count(*) > 1""")
def idempotency_key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a transaction share a position, so the key names many events."""
    log = change_log(spark, sf_dir).where("op <> 't'").withColumn("position", F.format_string("0/%04X", F.floor((F.col("seq") - 1) / 100)))
    id_ = F.coalesce(F.col("after")["id"], F.col("before")["id"])
    return log.groupBy(idempotency_key().alias("idempotency_key")).agg(F.count("*").alias("events"), F.countDistinct(id_).alias("rows_lost_if_deduplicated")).where("events > 1")


@query(f"with {LOG} select 'public.users' as qualified, op, count(*) as events from log group by op")
def op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.op_counts(change_log(spark, sf_dir))


class Counting:
    """A sink that counts what it gets, and what it gets after a newer event; it may refuse every so many-th batch."""

    def __init__(self, name: str, refuse: int = 0):
        self.name, self.refuse, self.calls, self.got, self.late, self.last = name, refuse, 0, 0, 0, 0

    def write(self, events) -> None:
        self.calls += 1
        if self.refuse and self.calls % self.refuse == 0:
            raise RuntimeError("busy")
        for e in events:
            seq = e["seq"]
            if seq < self.last:
                self.late += 1
            else:
                self.last = seq
        self.got += len(events)

    def close(self) -> None:
        pass


def routed(spark: SparkSession, log: DataFrame, sinks: list, **policy) -> Router:
    """The whole log through the router that a pipeline runs, to all sinks; what failed is tried again at once."""
    store, metrics = ControlStore(":memory:"), Registry()
    store.migrate()
    store.acquire("users", "me", 1e9)
    router = Router("users", "me", store, [Delivery("users", "me", s, store, Policy(**policy), metrics, sleep=lambda x: False) for s in sinks], metrics=metrics)
    router.foreach_batch(log, 0)
    return router


@query(f"""with {LOG} select s as sink, count(*) as events, 0::bigint as out_of_order from log cross join (select unnest(['stdout','mirror','broker']) as s) group by s""")
def fanout_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that each of three sinks got through the router, one of them refusing now and then, and how many came after a newer one."""
    sinks = [Counting("stdout"), Counting("mirror"), Counting("broker", 3)]
    routed(spark, change_log(spark, sf_dir), sinks)
    return spark.createDataFrame([(s.name, s.got, s.late) for s in sinks], "sink string, events long, out_of_order long")


@query(f"""with {LOG}, w as (select *, date_trunc('hour', commit_ts) as h, (row_number() over (partition by date_trunc('hour', commit_ts) order by seq) - 1) // 5 as number from log)
  select h as "window", number, count(*) as events, min(seq) as first_seq, max(seq) as last_seq from w group by 1, 2""")
def batch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = route.batches(change_log(spark, sf_dir), 5, "1 hour")
    return d.groupBy(F.col("batch.window").cast("timestamp_ntz").alias("window"), F.col("batch.number").alias("number")).agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("select k::bigint as failures, least(30000, 250 * pow(2, k - 1))::bigint as delay_ms from (select unnest(range(1, 13)) as k)")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 13).select(F.col("id").alias("failures"), route.retry_delays(F.col("id")).alias("delay_ms"))


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks that have come to different places: a tenth, a half and all of the log."""
    log = change_log(spark, sf_dir)
    n = F.lit(spark.read.parquet(f"{sf_dir}/events.parquet").count())
    share = F.when(F.col("sink") == "stdout", n).when(F.col("sink") == "mirror", F.floor(n / 2)).otherwise(F.floor(n / 10))
    return route.fan_out(log, SINKS).where(F.col("seq") <= share)


CURSORS = f"{LOG}, n as (select count(*) as n from log), c as (select sink, max(seq) as seq from log, n, (select unnest(['stdout','mirror','broker']) as sink) where seq <= case sink when 'stdout' then n when 'mirror' then n // 2 else n // 10 end group by sink)"


@query(f"with {CURSORS} select sink, printf('0/%04X', seq) as position, seq from c")
def sink_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.cursors(_delivered(spark, sf_dir))


@query(f"with {CURSORS} select printf('0/%04X', min(seq)) as position, min(seq) as seq from c having count(*) = 3")
def slowest_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.slowest(route.cursors(_delivered(spark, sf_dir)), len(SINKS))


@query(f"""with {LOG}, e as (select (seq - 1) // 100 as batch, seq, source_id, position, {EVENT} as ev from log)
  select batch, source_id, count(*) as "count", arg_min(position, seq) as first_position, arg_max(position, seq) as last_position,
    source_id || '|' || arg_min(position, seq) || '|' || arg_max(position, seq) as batch_id, '[' || string_agg(ev, ',' order by seq) || ']' as events from e group by batch, source_id""")
def webhook_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = route.batches(change_log(spark, sf_dir), 100).withColumn("batch", F.col("batch.number"))
    return route.envelopes(d, ["batch"], json_event(NUMBERS))


UPSERT = """case when op = 't' then 'DELETE FROM "public"."users"' when op = 'd' then 'DELETE FROM "public"."users" WHERE "id" = $1'
  when has_props then 'INSERT INTO "public"."users" ("id", "kind", "props", "value") VALUES ($1, $2, $3, $4) ON CONFLICT ("id") DO UPDATE SET "kind" = excluded."kind", "props" = excluded."props", "value" = excluded."value"'
  else 'INSERT INTO "public"."users" ("id", "kind", "value") VALUES ($1, $2, $3) ON CONFLICT ("id") DO UPDATE SET "kind" = excluded."kind", "value" = excluded."value"' end"""


@query(f"with {LOG} select seq, {UPSERT} as statement from log")
def upsert_sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_log(spark, sf_dir).select("seq", naming.upsert_statement(KEYS).alias("statement"))


@query(f"with {LOG} select seq, case when op = 't' then 'UPDATE \"mirror\".\"users\" SET \"_deleted_at\" = now() WHERE \"_deleted_at\" IS NULL' when op = 'd' then 'UPDATE \"mirror\".\"users\" SET \"_deleted_at\" = now() WHERE \"id\" = $1' end as statement from log where op in ('d','t')")
def soft_delete_sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements against another schema that stamp rows instead of deleting them."""
    return change_log(spark, sf_dir).where("op in ('d', 't')").select("seq", naming.upsert_statement(KEYS, schema="mirror", soft_delete=True).alias("statement"))


@query(f"""with {LOG} select seq, 'cdc.public.users' as topic, case when op = 't' then 'public.users|<nil>' else 'public.users|' || id end as key, {EVENT} as value,
  op || ';' || source_id || ';' || position || ';' || source_id || '|public.users|' || position || ';application/json' as header_values from log""")
def kafka_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = encode(change_log(spark, sf_dir), "json", "value", NUMBERS)
    headers = F.array_join(F.transform(route.message_headers(), lambda h: h["value"]), ";")
    return d.select("seq", naming.kafka_topic("cdc").alias("topic"), naming.partition_key(KEYS).alias("key"), "value", headers.alias("header_values"))


@query(f"with {TABLES} select seq, case when q = 'public.users' then q || '|' || case when op = 't' then '<nil>' else id::varchar end when q = 'users' then q when \"table\" = 'users' then q else q end as key from named")
def kafka_partition_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed tables are spread by row, others stay on one partition."""
    return _tables(spark, sf_dir).select("seq", naming.partition_key(KEYS).alias("key"))


@query(f"with {TABLES} select distinct regexp_replace('cdc.' || q, '[^A-Za-z0-9._-]', '_', 'g') as topic, 'fixed' as fixed_topic from named")
def kafka_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select(naming.kafka_topic("cdc").alias("topic"), naming.kafka_topic("cdc", "fixed").alias("fixed_topic")).distinct()


@query(f"""with {TABLES} select distinct "schema", "table", 'cdc' || case when "schema" = '' then '' else '.' || regexp_replace("schema", '[.*> ]', '_', 'g') end || '.' || regexp_replace("table", '[.*> ]', '_', 'g') as subject from named""")
def nats_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select("schema", "table", naming.nats_subject("cdc").alias("subject")).distinct()


@query("select distinct p_type as name, regexp_replace(lower(p_type), '[^a-z0-9_]', '_', 'g') as slug from part")
def slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("name"), naming.slug(F.col("p_type")).alias("slug")).distinct()


@query(f"with {LOG} select seq, octet_length(encode({EVENT}))::bigint as json_bytes, true as smaller from log")
def protobuf_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every event in both encodings; protobuf is the smaller one. What it holds is in protobuf_roundtrip."""
    d = encode(encode(change_log(spark, sf_dir), "protobuf", "proto", NUMBERS), "json", "json", NUMBERS)
    return d.select("seq", F.octet_length("json").cast("long").alias("json_bytes"), (F.octet_length("proto") < F.octet_length("json")).alias("smaller"))
