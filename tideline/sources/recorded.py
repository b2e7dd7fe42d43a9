"""Readers over recordings: the messages of a database's log as Parquet tables, decoded batch by batch.

A recording is a folder. `messages` holds the log in files that come in its order, each row with the
number `seq` it was received under; `relations` (PostgreSQL) and `tables` (MySQL) hold what
the messages only refer to: the columns of a table from a log number on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Source as SourceConfig
from ..functions.positions import parse_lsn
from ..model import SCHEMA
from . import mongo, mysql, postgres
from .base import LogReader

#: Rows up to which a table of columns is broadcast.
BROADCAST_ROWS = 100_000

PG_MESSAGES = "seq long, kind string, lsn string, xid long, relation_ids array<long>, old struct<kinds: array<string>, values: array<string>>, new struct<kinds: array<string>, values: array<string>>, commit_ts timestamp"
PG_RELATIONS = "from_seq long, relation_id long, `schema` string, `table` string, names array<string>, keys array<string>"
MYSQL_EVENTS = "seq long, file string, type string, query string, gtid string, `schema` string, `table` string, kind string, rows array<array<string>>, ts long"
MYSQL_TABLES = "from_seq long, `schema` string, `table` string, names array<string>, keys array<string>"
MONGO_DOCS = "seq long, doc string"


def as_of(rows: DataFrame, versions: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """rows with the values of the version that was in force at their seq; null where none was.

    The versions of one thing (its schema changes) meet in an array, so the join is an equi-join; the
    table of them is broadcast while it is small.
    """
    v = versions.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("from_seq", *values))).alias("_versions"))
    v = F.broadcast(v) if versions.count() <= BROADCAST_ROWS else v
    now = F.filter("_versions", lambda x: x["from_seq"] <= F.col("seq"))
    return rows.join(v, on, "left").withColumn("_now", F.try_element_at(now, F.lit(-1))).select(*rows.columns, *[F.col(f"_now.{c}").alias(c) for c in values])


def _latest_keys(versions: DataFrame) -> dict[str, list[str]]:
    """Key columns by qualified table, in the order of names: one row a table."""
    rows = versions.groupBy("schema", "table").agg(F.max_by("keys", "from_seq").alias("keys")).orderBy("schema", "table").collect()
    return {f"{r['schema']}.{r['table']}": list(r["keys"] or []) for r in rows}


def decode_postgres(messages: DataFrame, relations: DataFrame, source_id: str, begins: DataFrame | None = None) -> DataFrame:
    """Change records of logical-replication messages.

    Kinds: B begins a transaction and knows its commit time, C ends it; I, U, D change a row;
    T truncates one relation or more and becomes a record for each, in order. Others (M, O, Y) carry no change.
    A row's relation is the one in force at its place in the log; one that is not known fails
    the query. A record's position is the start of its own message. begins: (xid, commit_ts) of
    transactions that began before these messages.
    """
    known = messages.where("kind = 'B'").select("xid", "commit_ts")
    known = (known if begins is None else known.unionByName(begins)).groupBy("xid").agg(F.max("commit_ts").alias("committed"))
    rows = messages.where(F.col("kind").isin("I", "U", "D", "T")).drop("commit_ts").withColumn("relation_id", F.explode("relation_ids"))
    rows = as_of(rows, relations, ["relation_id"], ["schema", "table", "names"]).join(known, "xid", "left")
    table = F.coalesce("table", F.raise_error(F.concat(F.lit("unknown relation "), F.col("relation_id").cast("string"))))
    image = lambda c: F.when(F.col(c).isNotNull(), postgres.decode_tuple(F.col("names"), F.col(f"{c}.kinds"), F.col(f"{c}.values")))
    op = F.try_element_at(F.create_map(*[x for k, v in postgres.ROW_KINDS.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    return rows.select("seq", F.lit(source_id).alias("source_id"), "schema", table.alias("table"), op.alias("op"), image("old").alias("before"), image("new").alias("after"), F.col("lsn").alias("position"), F.col("committed").alias("commit_ts"))


def decode_mysql(events: DataFrame, tables: DataFrame, source_id: str, start: str = "", capture: list[str] | None = None) -> DataFrame:
    """Change records of binary log events.

    A record's position is the set of transactions that had ended before its own began, so to resume there
    repeats a transaction and skips none. Columns are those in force at the event's place; a table
    that is not known fails the query.
    """
    boundary = (F.col("type") == "xid") | ((F.col("type") == "query") & F.coalesce(mysql.is_boundary(F.col("query")), F.lit(False)))
    stamped = mysql.stamp_positions(events.withColumn("boundary", boundary), start=start)
    rows = stamped.where(F.col("type") == "rows").where(mysql.captures(capture or []))
    rows = as_of(rows.withColumnRenamed("rows", "images"), tables, ["schema", "table"], ["names"])
    names = F.coalesce("names", F.raise_error(F.concat(F.lit("unknown table "), F.col("schema"), F.lit("."), F.col("table"))))

    def image(values: Column) -> Column:
        n = F.least(F.size("names"), F.size(values))
        return F.when(values.isNotNull(), F.map_from_arrays(F.slice("names", F.lit(1), n), F.slice(values, F.lit(1), n)))

    pairs = mysql.row_pairs(rows.withColumn("names", names), rows="images")
    return pairs.select("seq", F.lit(source_id).alias("source_id"), "schema", "table", "op", image(F.col("before")).alias("before"), image(F.col("after")).alias("after"), "position", F.timestamp_seconds("ts").alias("commit_ts"))


class _Recording(LogReader):
    def __init__(self, config: SourceConfig, path: str, schema: str):
        self.config, self.source_id, self.root = config, config.id, path.rstrip("/")
        self.path, self.raw_schema, self.acked = f"{self.root}/messages", schema, None

    def _records(self, d: DataFrame) -> DataFrame:
        return d.select(*SCHEMA.fieldNames())


class PostgresRecording(_Recording):
    """Messages of a PostgreSQL publication."""

    def __init__(self, config: SourceConfig):
        super().__init__(config, config.postgres.recording, PG_MESSAGES)
        self.open_: tuple | None = None  # the transaction that the last batch may have broken off in
        self.progress = postgres.Progress()

    def ack(self, position: str) -> None:
        """Everything up to a position is with all sinks; never backwards."""
        self.progress.ack(parse_lsn(position))

    def lag_bytes(self, spark: SparkSession) -> int | None:
        """Bytes from what was acknowledged to the log's end; unknown before the first acknowledgement."""
        position, _ = self.end(spark)
        if position:
            self.progress.emit(parse_lsn(position))
            self.progress.idle(parse_lsn(position))
        return self.progress.lag()

    def _relations(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(PG_RELATIONS).parquet(f"{self.root}/relations")

    def tables(self, spark: SparkSession) -> dict[str, list[str]]:
        """Those configured, else all that are captured; one that isn't captured is refused, as is a table without key."""
        known = _latest_keys(self._relations(spark))
        want = [".".join(postgres.parse_table(t)) for t in self.config.postgres.tables]
        postgres.reconcile(want, list(known), all_tables=not want, add=self.config.postgres.auto_add_tables)
        out = {t: known[t] for t in (want or known) if t in known}  # one added to the publication has no row yet
        for t, keys in out.items():
            if not keys:
                raise ValueError(f"table {t} has no primary key and can't be read in chunks")
        return out

    def decode(self, batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        begins = spark.createDataFrame([self.open_], "xid long, commit_ts timestamp") if self.open_ else None
        out = decode_postgres(batch, self._relations(spark), self.source_id, begins)
        last = batch.where("kind = 'B'").orderBy(F.desc("seq")).select("xid", "commit_ts").first()
        self.open_ = tuple(last) if last else self.open_
        want = [".".join(postgres.parse_table(t)) for t in self.config.postgres.tables]
        return self._records(out.where(F.concat_ws(".", "schema", "table").isin(want)) if want else out)

    def log(self, spark: SparkSession, after: int = 0, upto: int | None = None) -> DataFrame:
        """A range on its own: the transaction it may begin in is looked up."""
        d = self.stored(spark).where(F.col("seq") > after)
        d = d if upto is None else d.where(F.col("seq") <= upto)
        first = self.stored(spark).where((F.col("seq") <= after) & (F.col("kind") == "B")).agg(F.max(F.struct("seq", "xid", "commit_ts")).alias("b")).select("b.xid", "b.commit_ts").where("xid is not null") if after else None
        return self._records(decode_postgres(d, self._relations(spark), self.source_id, first))

    def end(self, spark: SparkSession) -> tuple[str, int]:
        """The last change: commits and other messages have positions of their own, which nothing acknowledges."""
        row = self.stored(spark).agg(F.max_by("lsn", F.when(F.col("kind").isin(*postgres.ROW_KINDS), F.col("seq"))), F.max("seq")).first()
        return row[0] or "", row[1] or 0


class MySQLRecording(_Recording):
    """Events of a MySQL binary log."""

    def __init__(self, config: SourceConfig):
        super().__init__(config, config.mysql.recording, MYSQL_EVENTS)
        self.executed: str | None = None

    def _tables(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(MYSQL_TABLES).parquet(f"{self.root}/tables")

    def tables(self, spark: SparkSession) -> dict[str, list[str]]:
        known = _latest_keys(self._tables(spark))
        database = mysql.parse_dsn(self.config.mysql.dsn)["database"] if self.config.mysql.dsn else ""
        return {t: known[t] for t in mysql.snapshot_tables(self.config.mysql.tables, list(known), database)}

    def _executed_before(self, spark: SparkSession, seq: int) -> str:
        """The set of transactions that had ended before an event."""
        ended = (F.col("type") == "xid") | ((F.col("type") == "query") & F.coalesce(mysql.is_boundary(F.col("query")), F.lit(False)))
        return self.stored(spark).where((F.col("seq") < seq) & ended).agg(F.max_by("gtid", "seq")).first()[0] or ""

    def decode(self, batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        first, last = batch.agg(F.min("seq"), F.max("seq")).first()
        if first is None:
            return spark.createDataFrame([], SCHEMA)
        start = self.executed if self.executed is not None else self._executed_before(spark, first)
        ended = (F.col("type") == "xid") | ((F.col("type") == "query") & F.coalesce(mysql.is_boundary(F.col("query")), F.lit(False)))
        self.executed = batch.where(ended).agg(F.max_by("gtid", "seq")).first()[0] or start
        return self._records(decode_mysql(batch, self._tables(spark), self.source_id, start, self.config.mysql.tables))

    def log(self, spark: SparkSession, after: int = 0, upto: int | None = None) -> DataFrame:
        d = self.stored(spark).where(F.col("seq") > after)
        d = d if upto is None else d.where(F.col("seq") <= upto)
        start = self._executed_before(spark, after + 1) if after else ""
        return self._records(decode_mysql(d, self._tables(spark), self.source_id, start, self.config.mysql.tables))

    def end(self, spark: SparkSession) -> tuple[str, int]:
        last = self.stored(spark).agg(F.max("seq")).first()[0] or 0
        return self._executed_before(spark, last + 1), last


class MongoRecording(_Recording):
    """Documents of a MongoDB change stream."""

    def __init__(self, config: SourceConfig):
        super().__init__(config, config.mongodb.recording, MONGO_DOCS)

    def tables(self, spark: SparkSession) -> dict[str, list[str]]:
        return {f"{self.config.mongodb.database}.{c}": ["_id"] for c in self.config.mongodb.collections}

    def decode(self, batch: DataFrame) -> DataFrame:
        d = mongo.change_events(batch, "doc", self.source_id, self.config.mongodb.full_document)
        c = self.config.mongodb
        d = d.where(F.col("schema") == c.database) if c.database else d
        return self._records(d.where(F.col("table").isin(c.collections)) if c.collections else d)
