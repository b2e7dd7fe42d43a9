"""What a source is, and which ones there are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Source as SourceConfig
from ..model import qualified
from ..operators.apply import image_state, read_events
from ..operators.snapshot import keyset_page
from .changelog import KEYS


@dataclass(frozen=True)
class ReadRequest:
    """Where to start: after the event number seq, or, where only a position is known, before its first event.

    Rows of one snapshot, chunk or transaction share a position, so a position alone can't say how many of them were delivered.
    """

    position: str | None = None
    seq: int | None = None


class Reader(Protocol):
    """A log and the tables it speaks of."""

    def read_changes(self, spark: SparkSession, request: ReadRequest) -> DataFrame:
        """The stored log as a stream, from the request on."""

    def decode(self, batch: DataFrame) -> DataFrame:
        """Change records of a micro-batch of that stream. Batches come in order, once a reader."""

    def log(self, spark: SparkSession, after: int = 0, upto: int | None = None) -> DataFrame:
        """Change records numbered above `after` up to `upto`, as a batch frame."""

    def end(self, spark: SparkSession) -> tuple[str, int]:
        """Position and number of the newest event; ('', 0) before the first."""

    def tables(self, spark: SparkSession) -> dict[str, list[str]]:
        """Key columns by qualified table, in the order in which they are to be read."""

    def snapshot(self, spark: SparkSession, table: str, at: int, position: str) -> DataFrame:
        """A table's rows as read events as they stood after event `at`."""

    def page(self, spark: SparkSession, table: str, after: list[str] | None, size: int, at: int, position: str) -> DataFrame:
        """The next `size` of those rows by key."""


class SourceNotAvailable(NotImplementedError):
    """A source whose client library isn't installed here."""


class LogReader:
    """What readers over stored logs share. One says where its log lies (`path`) and how a stored batch becomes records (`decode`).

    A table is read by folding the log up to a point, which reads that much of it: for replays and
    tests; a live database is read over JDBC (jdbc_rows).
    """

    source_id: str
    path: str
    max_files: int = 16
    raw_schema: object = None

    def decode(self, batch: DataFrame) -> DataFrame:
        return batch

    def ack(self, position: str) -> None:
        """The newest position that may be forgotten; a stored log forgets nothing."""
        self.acked = position

    def stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.raw_schema).parquet(self.path) if self.raw_schema is not None else spark.read.parquet(self.path)

    def starts_after(self, spark: SparkSession, request: ReadRequest) -> int:
        if request.seq is not None:
            return request.seq
        if not request.position:
            return 0
        found = self.log(spark).where(F.col("position") == request.position).agg(F.min("seq")).first()[0]
        if found is None:
            raise ValueError(f"the log has no position {request.position!r}")
        return found - 1

    def read_changes(self, spark: SparkSession, request: ReadRequest) -> DataFrame:
        schema = self.raw_schema if self.raw_schema is not None else self.stored(spark).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", self.max_files).parquet(self.path)
        return stream.where(F.col("seq") > self.starts_after(spark, request))

    def log(self, spark: SparkSession, after: int = 0, upto: int | None = None) -> DataFrame:
        d = self.stored(spark).where(F.col("seq") > after)
        return self.decode(d if upto is None else d.where(F.col("seq") <= upto))

    def end(self, spark: SparkSession) -> tuple[str, int]:
        last = self.stored(spark).agg(F.max("seq")).first()[0]
        if not last:
            return "", 0
        row = self.log(spark, max(0, last - 1)).select("position").first()
        return (row[0] if row else "", last)

    def tables(self, spark: SparkSession) -> dict[str, list[str]]:
        raise NotImplementedError

    def _rows(self, spark: SparkSession, table: str, at: int) -> DataFrame:
        keys = self.tables(spark).get(table)
        if not keys:
            raise ValueError(f"table {table} has no key columns to read it by")
        return image_state(self.log(spark, 0, at).where(qualified() == table), keys)

    def snapshot(self, spark: SparkSession, table: str, at: int, position: str) -> DataFrame:
        return read_events(self._rows(spark, table, at), self.source_id, *split_table(table), position, at)

    def page(self, spark: SparkSession, table: str, after: list[str] | None, size: int, at: int, position: str) -> DataFrame:
        keys = self.tables(spark)[table]
        rows = keyset_page(self._rows(spark, table, at), [f"key.{k}" for k in keys], after, size)
        return read_events(rows, self.source_id, *split_table(table), position, at)


def split_table(name: str) -> tuple[str, str]:
    schema, dot, table = name.partition(".")
    return (schema, table) if dot else ("", name)


@dataclass
class ChangelogReader(LogReader):
    """A change log kept as Parquet, in the record's own form."""

    config: SourceConfig
    acked: str | None = field(default=None, init=False)

    def __post_init__(self):
        from ..model import SCHEMA

        self.source_id, self.path, self.max_files, self.raw_schema = self.config.id, self.config.changelog.path, self.config.changelog.max_files, SCHEMA

    def tables(self, spark: SparkSession) -> dict[str, list[str]]:
        return dict(self.config.changelog.keys) or dict(KEYS)


@dataclass
class DatabaseReader:
    """A live database. Its messages need a client library; decoding is in this package's modules."""

    config: SourceConfig
    library: str

    def read_changes(self, spark: SparkSession, request: ReadRequest) -> DataFrame:
        raise SourceNotAvailable(f"source {self.config.type!r} needs the library {self.library}; record its messages and set `recording`, or feed a change log")


def _postgres(c: SourceConfig):
    from .recorded import PostgresRecording

    return PostgresRecording(c) if c.postgres.recording else DatabaseReader(c, "psycopg")


def _mysql(c: SourceConfig):
    from .recorded import MySQLRecording

    return MySQLRecording(c) if c.mysql.recording else DatabaseReader(c, "mysql-replication")


def _mongo(c: SourceConfig):
    from .recorded import MongoRecording

    return MongoRecording(c) if c.mongodb.recording else DatabaseReader(c, "pymongo")


READERS: dict[str, Callable[[SourceConfig], Reader]] = {"changelog": ChangelogReader, "postgres": _postgres, "postgresql": _postgres, "mysql": _mysql, "mongodb": _mongo, "mongo": _mongo}


def build_reader(config: SourceConfig) -> Reader:
    if config.type not in READERS:
        raise ValueError(f"unknown source type {config.type!r}; known: {', '.join(sorted(READERS))}")
    return READERS[config.type](config)


def jdbc_rows(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, predicates: list[str] | None = None) -> DataFrame:
    """A table's rows over JDBC, one partition a predicate; needs the driver's jar. Read as read events by apply.snapshot_events."""
    if predicates:
        return spark.read.jdbc(url, table, predicates=predicates, properties=properties or {})
    return spark.read.jdbc(url, table, properties=properties or {})
