"""Queries on the decoders of the three sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import positions
from ..functions.encoding import image_json
from ..sources import mongo, mysql, postgres
from ..sources.changelog import change_log
from .registry import LOG, query


@query(f"with {LOG} select seq, position, seq::decimal(20,0) as lsn from log")
def lsn_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_log(spark, sf_dir).select("seq", "position", positions.lsn(F.col("position")).alias("lsn"))


@query(f"with {LOG} select seq, case when seq - 250 > 0 then 250 end::decimal(20,0) as lag from log")
def lag_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag at every event of a reader that acknowledges 250 positions late."""
    server = positions.lsn(F.col("position"))
    return change_log(spark, sf_dir).select("seq", positions.lag_bytes(server, F.greatest(server - 250, F.lit(0))).alias("lag"))


@query("select event_id + 1 as seq, i::int as ordinal, ['public.users', 'public.orders', 'public.items'][i + 1] as qualified from events, (select unnest(range(0, 3)) as i) where i <= event_id % 3")
def truncate_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One truncate of several relations becomes one event each."""
    relations = spark.createDataFrame([(1, "public", "users"), (2, "public", "orders"), (3, "public", "items")], "relation_id int, `schema` string, `table` string")
    m = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") + 1).alias("seq"), F.sequence(F.lit(1), (F.col("event_id") % 3 + 1).cast("int")).alias("relation_ids"))
    return postgres.dispatch(m, relations).select("seq", "ordinal", F.concat_ws(".", "schema", "table").alias("qualified"))


@query("""select event_id + 1 as seq, '{"id":' || user_id || case when event_type = 'click' then ',"value":null' else ',"value":' || cast(value as decimal(10,2)) end || case when event_type = 'view' then '' else ',"zprops":"' || replace(props, '"', '\\"') || '"' end || '}' as image from events""")
def pg_tuple_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = F.array(*map(F.lit, ["id", "value", "zprops"]))
    kinds = F.array(F.lit("t"), F.when(F.col("event_type") == "click", "n").otherwise("t"), F.when(F.col("event_type") == "view", "u").otherwise("t"), F.lit("t"))
    values = F.array(F.col("user_id").cast("string"), F.col("value").cast("decimal(10,2)").cast("string"), "props", F.lit("beyond the relation"))
    return e.select((F.col("event_id") + 1).alias("seq"), image_json(postgres.decode_tuple(names, kinds, values), ["id", "value"]).alias("image"))


@query("select event_id + 1 as seq, user_id as id, event_type as kind, try_cast(case when event_type = 'click' then 'x' else cast(cast(value as decimal(10,2)) as varchar) end as double) as value from events")
def pg_typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by declared type; a text that doesn't parse is null."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    image = F.create_map(F.lit("id"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("value"), F.when(F.col("event_type") == "click", "x").otherwise(F.col("value").cast("decimal(10,2)").cast("string")))
    return e.withColumn("m", image).select((F.col("event_id") + 1).alias("seq"), *postgres.typed(F.col("m"), {"id": "bigint", "kind": "string", "value": "double"}))


def _binlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row events of one to five images, a transaction of ten events, and a file of a thousand."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = (F.col("event_id") % 5 + 1).cast("int")
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(":", F.col("user_id").cast("string"), i.cast("string")))
    kind = F.when(F.col("event_type") == "signup", "write").when(F.col("event_type") == "error", "delete").otherwise("update")
    return e.select((F.col("event_id") + 1).alias("seq"), F.floor(F.col("event_id") / 1000).alias("file"), (F.col("event_id") % 10 == 9).alias("boundary"), F.concat(F.lit("a1b2:1-"), (F.floor(F.col("event_id") / 10) + 1).cast("string")).alias("gtid"), kind.alias("kind"), rows.alias("rows"))


@query("""with e as (select event_id + 1 as seq, user_id, event_id % 5 + 1 as n, case event_type when 'signup' then 'c' when 'error' then 'd' else 'u' end as op from events),
  x as (select *, unnest(range(0, case when op = 'u' then n // 2 else n end)) as i from e)
  select seq, op, i::int as ordinal, case op when 'u' then user_id || ':' || 2 * i when 'd' then user_id || ':' || i end as before, case op when 'u' then user_id || ':' || 2 * i + 1 when 'c' then user_id || ':' || i end as after from x""")
def mysql_update_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mysql.row_pairs(_binlog(spark, sf_dir)).select("seq", "op", "ordinal", "before", "after")


@query("select event_id + 1 as seq, case when event_id < 10 then '' else 'a1b2:1-' || (event_id // 10) end as position from events")
def mysql_gtid_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mysql.stamp_positions(_binlog(spark, sf_dir)).select("seq", "position")


DDL = ["COMMIT", " alter table t add c int", "CREATE INDEX i ON t (a)", "truncate users", "BEGIN", "SELECT 1", "rename table a to b", "commit work"]


@query(f"with q as (select event_id + 1 as seq, {DDL}[event_id % 8 + 1] as statement from events) select seq, upper(trim(statement)) = 'COMMIT' or regexp_matches(upper(trim(statement)), '^(ALTER|CREATE|DROP|RENAME|TRUNCATE)') as boundary, regexp_matches(statement, '(?i)ALTER|DROP|CREATE|RENAME') as forgets_schema from q")
def mysql_ddl_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, DDL)), (F.col("event_id") % 8 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("q", text).select((F.col("event_id") + 1).alias("seq"), mysql.is_boundary(F.col("q")).alias("boundary"), mysql.invalidates_schema(F.col("q")).alias("forgets_schema"))


@query("select event_type, count(*) as events from events where event_type in ('click', 'view') group by 1")
def mysql_capture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("schema", F.lit("Shop")).withColumn("table", F.initcap("event_type"))
    return e.where(mysql.captures(["shop.CLICK", "SHOP.view"])).groupBy("event_type").agg(F.count("*").alias("events"))


def _change_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-stream documents made from events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "replace").when(F.col("event_type") == "purchase", "update").otherwise("rename")
    key = F.concat(F.lit('{"_id":'), F.col("user_id").cast("string"), F.lit("}"))
    full = F.when(kind.isin("insert", "replace"), F.concat(F.lit(',"fullDocument":{"_id":'), F.col("user_id").cast("string"), F.lit(',"note":"'), "event_type", F.lit('"}'))).otherwise("")
    changed = F.when(kind == "update", F.concat(F.lit(',"updateDescription":{"updatedFields":{"note":"n'), F.col("event_id").cast("string"), F.lit('"}}'))).otherwise("")
    doc = F.concat(F.lit('{"_id":{"_data":"'), F.hex("event_id"), F.lit('"},"operationType":"'), kind, F.lit('","ns":{"db":"app","coll":"users"},"clusterTime":{"$timestamp":{"t":'), (F.col("event_id") + 1700000000).cast("string"), F.lit(',"i":1}},"documentKey":'), key, full, changed, F.lit("}"))
    return e.select((F.col("event_id") + 1).alias("seq"), doc.alias("doc"))


@query("""select event_id + 1 as seq, case event_type when 'signup' then 'c' when 'error' then 'd' else 'u' end as op, 'app.users' as qualified, 'token:' || printf('%X', event_id) as position,
  to_timestamp(event_id + 1700000000) at time zone 'UTC' as commit_ts, case when event_type = 'error' then '{"_id":"' || user_id || '"}' end as before,
  case event_type when 'error' then null when 'purchase' then '{"_id":"' || user_id || '","note":"n' || event_id || '"}' else '{"_id":"' || user_id || '","note":"' || event_type || '"}' end as after from events where event_type <> 'view'""")
def mongo_event_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mongo.change_events(_change_docs(spark, sf_dir))
    return c.select("seq", "op", F.concat_ws(".", "schema", "table").alias("qualified"), "position", F.col("commit_ts").cast("timestamp_ntz").alias("commit_ts"), image_json(F.col("before")).alias("before"), image_json(F.col("after")).alias("after"))


@query("select event_id as n, case when event_id % 2 = 0 then 'token' else 'ts' end as kind, case when event_id % 2 = 0 then printf('%X', event_id) end as token, case when event_id % 2 = 1 then event_id + 1700000000 end as t, case when event_id % 2 = 1 then event_id % 7 end as i from events")
def mongo_position_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("token:"), F.hex("event_id"))).otherwise(F.concat(F.lit("ts:"), (F.col("event_id") + 1700000000).cast("string"), F.lit(","), (F.col("event_id") % 7).cast("string")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("n"), positions.mongo_position(text).alias("p")).select("n", "p.*")
