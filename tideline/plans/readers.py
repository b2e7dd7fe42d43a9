"""Queries on readers: recorded messages of the three sources, from the raw message to the folded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MongoDB, MySQL, Postgres, Source
from ..functions.encoding import image_json
from ..operators.apply import image_state
from ..sources import recorded
from ..sources.base import ReadRequest, build_reader
from ..sources.changelog import COLUMNS, KEYS, change_log
from ..streaming.control import ControlStore
from ..streaming.delivery import FrameDelivery, Router
from ..streaming.observe import Registry
from ..streaming.runner import Resume, SnapshotHooks
from ..streaming.service import Bootstrap
from ..streaming.sinks import MirrorSink
from .registry import LOG, STATE, query
from .scratch import drop, folder, kept, write_log

KEY = KEYS["public.users"]
ALL = STATE.format(upto="true")
#: Events to a transaction of the recordings.
TRANSACTION = 7


def record_postgres(spark: SparkSession, sf_dir: str, root: str) -> None:
    """The change log of public.users as publication messages: rows, begins and commits, other kinds, and a relation that changes its columns."""
    log = change_log(spark, sf_dir)
    names = F.array(*map(F.lit, ["id", "kind", "value", "props"]))
    value = lambda i: F.transform(names, lambda k: F.get(F.filter(F.map_entries(i), lambda e: e["key"] == k), F.lit(0))["value"])
    kinds = lambda i: F.transform(names, lambda k: F.when(~F.map_contains_key(i, k), "u").when(i[k].isNull(), "n").otherwise("t"))
    tuple_ = lambda c: F.when(F.col(c).isNotNull(), F.struct(kinds(F.col(c)).alias("kinds"), value(F.col(c)).alias("values")))
    row = F.create_map(*[F.lit(x) for x in ("c", "I", "u", "U", "d", "D", "t", "T")])[F.col("op")]
    xid = F.floor((F.col("seq") - 1) / TRANSACTION)
    rows = log.select((F.col("seq") * 10).alias("seq"), row.alias("kind"), F.col("position").alias("lsn"), xid.alias("xid"), F.array(F.lit(1).cast("long")).alias("relation_ids"), tuple_("before").alias("old"), tuple_("after").alias("new"), F.lit(None).cast("timestamp").alias("commit_ts"))
    first = log.withColumn("xid", xid).groupBy("xid").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.max("commit_ts").alias("t"))
    none = lambda t: F.lit(None).cast(t)
    cell = "struct<kinds: array<string>, values: array<string>>"
    other = lambda seq, kind, ts: first.select(seq.alias("seq"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}/"), F.hex("a")).alias("lsn"), "xid", F.array(F.lit(99).cast("long")).alias("relation_ids"), none(cell).alias("old"), none(cell).alias("new"), ts.alias("commit_ts"))
    all_ = rows.unionByName(other(F.col("a") * 10 - 2, "B", F.col("t"))).unionByName(other(F.col("b") * 10 + 1, "C", none("timestamp"))).unionByName(other(F.col("b") * 10 + 2, "M", none("timestamp")))
    write_log(all_, f"{root}/messages")
    half = spark.read.parquet(f"{sf_dir}/events.parquet").count() // 2 * 10
    versions = [(0, 1, "public", "users", ["id", "kind", "value", "props"], ["id"]), (half, 1, "public", "users", ["id", "kind", "value", "props", "added"], ["id"]), (0, 2, "public", "other", ["a"], [])]
    spark.createDataFrame(versions, recorded.PG_RELATIONS).coalesce(1).write.parquet(f"{root}/relations")


def _postgres(spark: SparkSession, sf_dir: str):
    root = folder(spark, "recorded-postgres")
    record_postgres(spark, sf_dir, root)
    return root, build_reader(Source("postgres", "pg-main", postgres=Postgres(recording=root, tables=["public.users"])))


IMAGES = """case when op in ('c','u') then '{"id":"' || id || '","kind":"' || kind || '"' || case when has_props then ',"props":"' || replace(props, '"', '\\"') || '"' else '' end || ',"value":' || coalesce('"' || value || '"', 'null') || '}' end as after,
  case when op = 'd' then '{"id":"' || id || '"}' end as before"""


@query(f"""with {LOG} select seq, source_id, 'public.users' as qualified, op, {IMAGES}, position, max(commit_ts) over (partition by (seq - 1) // {TRANSACTION}) as commit_ts from log""")
def postgres_recorded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row messages with the names of their relation and the commit time of their transaction."""
    root, reader = _postgres(spark, sf_dir)
    d = reader.log(spark).select((F.col("seq") / 10).cast("long").alias("seq"), "source_id", F.concat_ws(".", "schema", "table").alias("qualified"), "op", image_json(F.col("after")).alias("after"), image_json(F.col("before")).alias("before"), "position", F.col("commit_ts").cast("timestamp_ntz").alias("commit_ts"))
    return kept(spark, d, "postgres-records", root)


class _Router(Router):
    """The router of a query: one mirror, a control store in memory."""

    def __init__(self, spark: SparkSession, path: str, table: str, keys: list[str], columns: dict[str, str]):
        store, self.sink = ControlStore(":memory:"), MirrorSink("mirror", path, {table: (keys, columns)}, 4)
        store.migrate()
        store.acquire("p", "me", 1e9)
        super().__init__("p", "me", store, [FrameDelivery("p", "me", self.sink, store)])
        self.hooks, self.spark, self.table = SnapshotHooks("p", "me", store, Registry()), spark, table

    def stream(self, reader, after: int) -> None:
        """The rest of the stored log, as a stream."""
        place = folder(self.spark, "stream")
        (d,) = self.deliveries
        q = reader.read_changes(self.spark, ReadRequest(seq=after)).writeStream.foreachBatch(lambda df, i: d.foreach_batch(reader.decode(df), i)).option("checkpointLocation", place).trigger(availableNow=True).start()
        q.awaitTermination()
        drop(self.spark, place)

    def state(self) -> DataFrame:
        return self.sink.mirror(self.spark, self.table).current()


@query(f"with {LOG}, {ALL} select id, kind, value, props from state")
def postgres_bootstrap_then_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables read at the middle of the log, then the messages after it, in a mirror: the state of the whole log."""
    root, reader = _postgres(spark, sf_dir)
    half = spark.read.parquet(f"{sf_dir}/events.parquet").count() // 2 * 10
    whole = reader.end
    reader.end = lambda s: (f"0/{half // 10:04X}", half)
    path = folder(spark, "mirror")
    router = _Router(spark, path, "public.users", KEY, COLUMNS)
    start = Bootstrap(spark, reader, router, router.hooks).begin(Resume(None, True), True, "single", 0, "slot")
    reader.end = whole
    router.stream(reader, start)
    return kept(spark, router.state().drop("last_seq"), "bootstrap-state", root, path)


def record_mysql(spark: SparkSession, sf_dir: str, root: str) -> None:
    """The change log as binary log events: two updates to a rows event, transactions, files, DDL, and a table that isn't captured."""
    log = change_log(spark, sf_dir).where("op <> 't'")
    names = F.array(*map(F.lit, ["id", "kind", "value", "props"]))
    cells = lambda c: F.transform(names, lambda k: F.get(F.filter(F.map_entries(c), lambda e: e["key"] == k), F.lit(0))["value"])
    image = F.coalesce("after", "before")
    kind = F.when(F.col("op") == "c", "write").when(F.col("op") == "d", "delete").otherwise("update")
    rows = F.when(F.col("op") == "u", F.array(cells(image), cells(image))).otherwise(F.array(cells(image)))
    file, group = F.format_string("bin.%06d", F.floor(F.col("seq") / 1000)), F.floor((F.col("seq") - 1) / TRANSACTION)
    base = log.select((F.col("seq") * 10).alias("seq"), file.alias("file"), F.lit("rows").alias("type"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("string").alias("gtid"), F.lit("shop").alias("schema"), F.when(F.col("seq") % 11 == 0, "audit").otherwise("users").alias("table"), kind.alias("kind"), rows.alias("rows"), F.unix_seconds("commit_ts").alias("ts"))
    ends = change_log(spark, sf_dir).groupBy(group.alias("g")).agg(F.max("seq").alias("b"))
    none = lambda t: F.lit(None).cast(t)
    end = lambda at, type_, text: ends.select((F.col("b") * 10 + at).alias("seq"), F.format_string("bin.%06d", F.floor(F.col("b") / 1000)).alias("file"), type_.alias("type"), text.alias("query"), F.concat(F.lit("a1b2:1-"), (F.col("g") + 1).cast("string")).alias("gtid"), none("string").alias("schema"), none("string").alias("table"), none("string").alias("kind"), none("array<array<string>>").alias("rows"), none("long").alias("ts"))
    ddl = F.when(F.col("g") % 5 == 0, F.lit("query")).otherwise("xid")
    text = F.when(F.col("g") % 5 == 0, F.lit("ALTER TABLE users ADD c INT"))
    noise = end(2, F.lit("query"), F.lit("BEGIN")).withColumn("gtid", F.lit("not yet"))
    write_log(base.unionByName(end(1, ddl, text)).unionByName(noise), f"{root}/messages")
    tables = [(0, "shop", "users", ["id", "kind", "value", "props"], ["id"]), (0, "shop", "audit", ["id", "kind", "value", "props"], ["id"])]
    spark.createDataFrame(tables, recorded.MYSQL_TABLES).coalesce(1).write.parquet(f"{root}/tables")


MYSQL_IMAGE = """'{"id":"' || id || '","kind":' || case when op = 'd' then 'null' else '"' || kind || '"' end || ',"props":' || case when op <> 'd' and has_props then '"' || replace(props, '"', '\\"') || '"' else 'null' end || ',"value":' || case when op <> 'd' and value is not null then '"' || value || '"' else 'null' end || '}'"""


@query(f"""with {LOG} select seq, 'shop.users' as qualified, op, case when op <> 'd' then {MYSQL_IMAGE} end as after, case when op <> 'c' then {MYSQL_IMAGE} end as before,
  case when seq <= {TRANSACTION} then '' else 'a1b2:1-' || (seq - 1) // {TRANSACTION} end as position, floor(epoch(commit_ts))::bigint as commit_s from log where op <> 't' and seq % 11 <> 0""")
def mysql_recorded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows events of captured tables, stamped with the transactions that had ended before their own."""
    root = folder(spark, "recorded-mysql")
    record_mysql(spark, sf_dir, root)
    reader = build_reader(Source("mysql", "my-main", mysql=MySQL(recording=root, tables=["SHOP.users"])))
    d = reader.log(spark).select((F.col("seq") / 10).cast("long").alias("seq"), F.concat_ws(".", "schema", "table").alias("qualified"), "op", image_json(F.col("after")).alias("after"), image_json(F.col("before")).alias("before"), "position", F.unix_seconds("commit_ts").alias("commit_s"))
    return kept(spark, d, "mysql-records", root)


MYSQL_STATE = f"""live as (select * from log where op <> 't' and seq % 11 <> 0),
  last as (select id, arg_max(op, seq) as op, max(seq) as s from live group by id)
  select l.id, l.kind, cast(l.value as double) as value, case when l.has_props then l.props end as props from live l join last on l.id = last.id and l.seq = last.s where last.op <> 'd'"""


@query(f"with {LOG}, {MYSQL_STATE}")
def mysql_snapshot_then_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The executed set is noted before the tables are read, so the stream repeats a part of them; the mirror absorbs it."""
    root = folder(spark, "recorded-mysql")
    record_mysql(spark, sf_dir, root)
    reader = build_reader(Source("mysql", "my-main", mysql=MySQL(recording=root, tables=["shop.users"])))
    path, half = folder(spark, "mirror"), spark.read.parquet(f"{sf_dir}/events.parquet").count() // 2 * 10
    whole = reader.end
    reader.end = lambda s: ("a1b2:1-1", half)
    router = _Router(spark, path, "shop.users", ["id"], COLUMNS)
    start = Bootstrap(spark, reader, router, router.hooks).begin(Resume(None, True), True, "single", 0, "server_id=1")
    reader.end = whole
    router.stream(reader, start // 2)
    return kept(spark, router.state().drop("last_seq"), "mysql-state", root, path)


def record_mongo(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Change-stream documents with extended JSON: ids, decimals, dates, cluster times, nested values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "replace").when(F.col("event_type") == "purchase", "update").otherwise("rename")
    s = lambda c: F.col(c).cast("string")
    key = F.concat(F.lit('{"_id": {"$oid": "u'), s("user_id"), F.lit('"}}'))
    body = F.concat(F.lit('"price": {"$numberDecimal": "'), F.col("value").cast("decimal(10,2)").cast("string"), F.lit('"}, "at": {"$date": {"$numberLong": "'), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit('"}}, "sub": {"n": [{"$numberInt": "'), (F.col("event_id") % 9).cast("string"), F.lit('"}, {"$timestamp": {"t": 5, "i": 2}}], "text": "a {\\"$oid\\": \\"x\\"} b"}'))
    full = F.when(kind.isin("insert", "replace"), F.concat(F.lit(', "fullDocument": {"_id": {"$oid": "u'), s("user_id"), F.lit('"}, '), body, F.lit("}"))).otherwise("")
    changed = F.when(kind == "update", F.concat(F.lit(', "updateDescription": {"updatedFields": {'), body, F.lit("}}"))).otherwise("")
    coll = F.when(F.col("event_id") % 13 == 0, "hidden").otherwise("users")
    doc = F.concat(F.lit('{"_id": {"_data": "'), F.hex("event_id"), F.lit('"}, "operationType": "'), kind, F.lit('", "ns": {"db": "app", "coll": "'), coll, F.lit('"}, "clusterTime": {"$timestamp": {"t": '), (F.col("event_id") + 1700000000).cast("string"), F.lit(', "i": 1}}, "documentKey": '), key, full, changed, F.lit("}"))
    write_log(e.select((F.col("event_id") + 1).alias("seq"), doc.alias("doc")), f"{root}/messages")


def _mongo(root: str):
    return build_reader(Source("mongodb", "mongo-main", mongodb=MongoDB(recording=root, database="app", collections=["users"])))


MONGO = """m as (select event_id + 1 as seq, user_id, event_id, event_type, '{"_id":"u' || user_id || '"' as head,
    ',"at":"' || regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), '\\.?0+$', '') || 'Z","price":"' || cast(value as decimal(10,2)) || '","sub":"{\\"n\\":[' || event_id % 9 || ',\\"5,2\\"],\\"text\\":\\"a {\\\\\\"$oid\\\\\\": \\\\\\"x\\\\\\"} b\\"}"}' as rest
  from events where event_type <> 'view' and event_id % 13 <> 0)"""


@query(f"""with {MONGO} select seq, 'app.users' as qualified, case event_type when 'signup' then 'c' when 'error' then 'd' else 'u' end as op, 'token:' || printf('%X', event_id) as position,
  event_id + 1700000000 as commit_s, case when event_type = 'error' then head || '}}' end as before, case when event_type <> 'error' then head || rest end as after from m""")
def mongo_recorded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-stream documents of one collection as records, their values in plain JSON."""
    root = folder(spark, "recorded-mongo")
    record_mongo(spark, sf_dir, root)
    d = _mongo(root).log(spark).select("seq", F.concat_ws(".", "schema", "table").alias("qualified"), "op", "position", F.unix_seconds("commit_ts").alias("commit_s"), image_json(F.col("before")).alias("before"), image_json(F.col("after")).alias("after"))
    return kept(spark, d, "mongo-records", root)


@query(f"""with {MONGO}, last as (select user_id, max(seq) as s, max(seq) filter (event_type = 'error') as d from m group by user_id)
  select 'u' || m.user_id as id, split_part(m.rest, '"price":"', 2)[1:strpos(split_part(m.rest, '"price":"', 2), '"') - 1]::decimal(10,2) as price from m join last on m.user_id = last.user_id and m.seq = last.s where last.s > coalesce(last.d, -1)""")
def mongo_snapshot_then_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection read at the middle, then its change stream."""
    root, path = folder(spark, "recorded-mongo"), folder(spark, "mirror")
    record_mongo(spark, sf_dir, root)
    reader, half = _mongo(root), spark.read.parquet(f"{sf_dir}/events.parquet").count() // 2
    whole = reader.end
    reader.end = lambda s: ("ts:1700000000,1", half)
    router = _Router(spark, path, "app.users", ["_id"], {"_id": "string", "price": "decimal(10,2)"})
    start = Bootstrap(spark, reader, router, router.hooks).begin(Resume(None, True), True, "single", 0, "app")
    reader.end = whole
    router.stream(reader, start)
    return kept(spark, router.state().select(F.col("_id").alias("id"), "price"), "mongo-state", root, path)


@query(f"with {LOG} select seq, 1::bigint as by_seq, case when seq > 200 and seq <= 250 then 2 else 1 end::bigint as by_position from log")
def resume_shared_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of each event when a run ends after event 250 inside a position of a hundred events: by seq, and by position alone."""
    log = change_log(spark, sf_dir).withColumn("position", F.format_string("0/%04X", F.floor((F.col("seq") - 1) / 100)))
    path = write_log(log, folder(spark, "shared-positions"))
    config = Source("changelog", "pg-main")
    config.changelog.path = path
    reader = build_reader(config)
    first = reader.log(spark, 0, 250).select("seq")
    at = reader.log(spark, 249, 250).first()
    again = lambda request, name: first.unionByName(reader.log(spark, reader.starts_after(spark, request)).select("seq")).groupBy("seq").agg(F.count("*").alias(name))
    out = again(ReadRequest(at["position"], at["seq"]), "by_seq").join(again(ReadRequest(at["position"]), "by_position"), "seq", "full_outer")
    return kept(spark, out, "deliveries", path)


@query(f"with {LOG}, {ALL} select id, kind, value, props, last_seq from state")
def mirror_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mirror after batches that overlap, come again under new numbers, and come late."""
    log, path = change_log(spark, sf_dir), folder(spark, "mirror")
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    m = MirrorSink("m", path, {"public.users": (KEY, COLUMNS)}, 4).mirror(spark, "public.users")
    part = lambda a, b: log.where((F.col("seq") > int(a * n)) & (F.col("seq") <= int(b * n)))
    for i, (a, b) in enumerate([(0.5, 0.8), (0, 0.3), (0.2, 0.6), (0.7, 1), (0, 0.5)]):
        m.apply(part(a, b), i % 2)
    return kept(spark, m.current(), "mirror-state", path)


@query(f"with {LOG}, {ALL} select id, kind, value, props, last_seq from state")
def image_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold that needs no declared columns gives the rows of the one that does."""
    s = image_state(change_log(spark, sf_dir), KEY)
    return s.select(*[F.col("image")[c].cast(t).alias(c) for c, t in COLUMNS.items()], "last_seq")


