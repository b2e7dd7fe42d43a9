"""From a configuration to running pipelines."""

from __future__ import annotations

import contextlib
import dataclasses
import json
import logging
import signal
import sqlite3
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Pipeline, SinkConfig
from ..config import Source as SourceConfig
from ..model import TRUNCATE, row_key
from ..sources.base import ReadRequest, build_reader
from .control import ControlStore
from .delivery import Delivery, FrameDelivery, Policy, Router, Stopped
from .observe import Health, Registry, Server
from .runner import Resume, Runner, SnapshotHooks, capture_id
from .sinks import BrokerSink, MirrorSink, NatsSink, ProcessSink, Sink, StdoutSink, UpsertSink, WebhookSink, partition_key, topic

log = logging.getLogger("tideline")


def open_store(dsn: str) -> ControlStore:
    """sqlite:<path> or a path."""
    return ControlStore(dsn.removeprefix("sqlite://").removeprefix("sqlite:"))


def _kafka(c: SinkConfig) -> Sink:
    try:
        from kafka import KafkaProducer
        from kafka.admin import KafkaAdminClient, NewTopic
    except ImportError as e:
        raise RuntimeError(f"sink {c.name!r} needs the library kafka-python") from e

    class Client:
        """Waits for all replicas; a topic that isn't there is made first if that is allowed, and is an error otherwise."""

        def __init__(self):
            self.producer = KafkaProducer(bootstrap_servers=c.kafka.brokers, acks="all", compression_type=c.kafka.compression or None, request_timeout_ms=int(c.kafka.timeout * 1000))
            self.admin = KafkaAdminClient(bootstrap_servers=c.kafka.brokers)
            self.known, self.sent = set(self.admin.list_topics()), []

        def publish(self, topic, key, value, headers):
            if topic not in self.known:
                if not c.kafka.auto_create_topics:
                    raise RuntimeError(f"topic {topic!r} does not exist and auto_create_topics is off")
                self.admin.create_topics([NewTopic(topic, num_partitions=-1, replication_factor=-1)])
                self.known.add(topic)
            self.sent.append(self.producer.send(topic, value, key.encode(), [(k, v.encode()) for k, v in headers.items()]))

        def flush(self):
            sent, self.sent = self.sent, []
            for f in sent:
                f.get(c.kafka.timeout)

        def close(self):
            self.producer.close()
            self.admin.close()

    return BrokerSink(c.name, Client(), lambda e: topic(c.kafka.topic_prefix, c.kafka.topic, e), lambda e: partition_key(c.kafka.keys, e), encoding=c.encoding)


def _nats(c: SinkConfig, connection) -> Sink:
    if connection is None:
        try:
            import asyncio

            import nats
        except ImportError as e:
            raise RuntimeError(f"sink {c.name!r} needs the library nats-py") from e

        class Connection:
            """The asynchronous client on a thread of its own; publish returns a future."""

            def __init__(self):
                self.loop = asyncio.new_event_loop()
                threading.Thread(target=self.loop.run_forever, daemon=True).start()
                options = {k: v for k, v in (("token", c.nats.token), ("user_credentials", c.nats.credentials_file)) if v}
                self.nc = self._run(nats.connect(c.nats.url, **options)).result(float(c.nats.ack_wait))
                self.js = None if c.nats.core_only else self.nc.jetstream()

            def _run(self, what):
                return asyncio.run_coroutine_threadsafe(what, self.loop)

            def publish(self, subject, payload, headers):
                return self._run((self.js or self.nc).publish(subject, payload, headers=headers))

            def flush(self, timeout):
                self._run(self.nc.flush(int(timeout))).result(timeout)

            def close(self):
                self._run(self.nc.drain()).result(float(c.nats.ack_wait))
                self.loop.call_soon_threadsafe(self.loop.stop)

        connection = Connection()
    return NatsSink(c.name, connection, c.nats.subject_prefix, c.nats.core_only, c.nats.max_pending, float(c.nats.ack_wait), c.encoding)


def _upsert(c: SinkConfig) -> Sink:
    dsn = c.pgupsert.dsn
    if dsn.startswith("sqlite:"):
        db, mark, now = sqlite3.connect(dsn.removeprefix("sqlite:").removeprefix("//"), check_same_thread=False), "?", "CURRENT_TIMESTAMP"
    else:
        try:
            import psycopg
        except ImportError as e:
            raise RuntimeError(f"sink {c.name!r} needs the library psycopg") from e
        db, mark, now = psycopg.connect(dsn), "%s", "now()"
    return UpsertSink(c.name, db, c.pgupsert.keys, c.pgupsert.schema or None, c.pgupsert.soft_delete, c.pgupsert.deleted_column, mark, now)


def _webhook(c: SinkConfig) -> Sink:
    if not c.webhook.url:
        raise ValueError(f"sink {c.name!r} needs webhook.url")
    return WebhookSink(c.name, c.webhook.url, c.webhook.headers, c.webhook.timeout)


#: Sinks by type.
SINKS: dict[str, Callable[[SinkConfig], Sink]] = {
    "stdout": lambda c: StdoutSink(c.name),
    "webhook": _webhook,
    "process": lambda c: ProcessSink(c.name, c.process.command, c.process.dir or None, dict(x.split("=", 1) for x in c.process.env), c.process.timeout, c.process.restart_on_error, c.encoding),
    "pgupsert": _upsert,
    "kafka": _kafka,
    "nats": lambda c: _nats(c, None),
    "mirror": lambda c: MirrorSink(c.name, c.mirror.path, {t: (m.keys, m.columns) for t, m in c.mirror.tables.items()}, c.mirror.buckets),
}


def build_sink(c: SinkConfig, nats_connection=None) -> Sink:
    if c.type not in SINKS:
        raise ValueError(f"unknown sink type {c.type!r}")
    return _nats(c, nats_connection) if c.type == "nats" and nats_connection is not None else SINKS[c.type](c)


def build_sinks(configs: list[SinkConfig]) -> list[Sink]:
    """All, or none: those already open are closed when one fails."""
    with contextlib.ExitStack() as opened:
        sinks = []
        for c in configs:
            sinks.append(build_sink(c))
            opened.callback(sinks[-1].close)
        opened.pop_all()
        return sinks


def policy(c: SinkConfig) -> Policy:
    return Policy(c.batch_max_events, float(c.batch_max_wait), c.queue_size, float(c.retry_initial), float(c.retry_max), c.on_failure == "dead_letter", c.max_attempts)


def snapshot_wish(source: SourceConfig) -> tuple[bool, str, int]:
    """(whether a first start reads the tables, how, rows a chunk)."""
    if source.type in ("postgres", "postgresql"):
        return source.postgres.snapshot, source.postgres.snapshot_mode, source.postgres.chunk_size
    if source.type == "mysql":
        return source.mysql.snapshot, "single", 0
    if source.type == "changelog":
        return source.changelog.snapshot, source.changelog.snapshot_mode, source.changelog.chunk_size
    return source.mongodb.snapshot, "single", 0


def split_by_window(rows: DataFrame, window: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that events of the window change, the others). A truncate changes all; both images of an event count."""
    if window.where(F.col("op") == TRUNCATE).limit(1).count():
        return rows, rows.limit(0)
    changed = window.select(F.explode(F.array_compact(F.array(row_key(keys, "before"), row_key(keys, "after")))).alias("_k")).distinct()
    d = rows.withColumn("_k", row_key(keys, "after"))
    return d.join(changed, "_k", "left_semi").drop("_k"), d.join(changed, "_k", "left_anti").drop("_k")


class Bootstrap:
    """Reads a source's tables into all sinks, at one point or in chunks, and says after which event the stream goes on."""

    def __init__(self, spark: SparkSession, reader, router: Router, hooks: SnapshotHooks, over: Callable[[], bool] = lambda: False):
        self.spark, self.reader, self.router, self.hooks, self.over = spark, reader, router, hooks, over

    def single(self, capture: str) -> int:
        """All tables as they stand at the log's end. It counts as done only once every sink has every row."""
        position, seq = self.reader.end(self.spark)
        self.hooks.started(capture, position)
        tables = self.reader.tables(self.spark)
        if not tables:
            raise ValueError("the source names no table to read")
        for table in tables:
            if self.over():
                raise Stopped(table)
            rows = self.reader.snapshot(self.spark, table, seq, position).persist()
            self.router.serve(rows)
            self.hooks.rows(rows.count())
            rows.unpersist()
        for d in self.router.deliveries:  # a sink that got no row still stands here
            self.router.store.advance_cursor(self.router.pipeline, self.router.holder, d.sink.name, position, seq)
        self.router.commit()
        self.hooks.completed(position)
        return seq

    def chunked(self, size: int, at: int, table: str | None = None, key: str | None = None) -> int:
        """The tables page by page in key order, while the log goes on.

        Around each page stand a low and a high mark, the ends of the log before and after it was read. Every sink gets the events
        up to the low mark, the rows that the window between the marks changes as the ground for its
        events, these events, and then the other rows. Only then is the page's last key saved; from there a
        new leader goes on, at the event that all sinks have.
        """
        tables = self.reader.tables(self.spark)
        names = list(tables)
        if table is not None and table not in names:
            log.warning("table %s of the unfinished snapshot is gone; starting anew", table)
            table = key = None
        for name in names[names.index(table) if table else 0 :]:
            after = json.loads(key) if name == table and key else None
            while True:
                if self.over():
                    raise Stopped(name)
                position, low = self.reader.end(self.spark)
                page = self.reader.page(self.spark, name, after, size, low, position).persist()
                n = page.count()
                top, high = self.reader.end(self.spark)
                window = self.reader.log(self.spark, low, high)
                ground, rest = split_by_window(page, window, tables[name])
                rest = rest.withColumn("seq", F.lit(high).cast("long")).withColumn("position", F.lit(top))
                # One frame in the order of seq: rows stand at the mark they belong to, and an event of that number is already in them.
                self.router.serve(self.reader.log(self.spark, at, high).unionByName(ground).unionByName(rest))
                self.hooks.rows(n)
                for d in self.router.deliveries:
                    self.router.store.advance_cursor(self.router.pipeline, self.router.holder, d.sink.name, top, high)
                at = high
                self.router.commit()
                if n:
                    last = page.select(*[F.col("after")[k].alias(k) for k in tables[name]]).orderBy(*[F.desc(k) for k in tables[name]]).first()
                    after = list(last)
                    self.hooks.chunk_accepted(name, json.dumps(after))
                page.unpersist()
                if n < size:
                    break
        self.hooks.completed()
        return at

    def begin(self, plan: Resume, wanted: bool, mode: str, size: int, capture: str) -> int:
        """What the plan asks for; the number of the event after which the stream goes on."""
        self.hooks.mode = mode
        if plan.chunk_table:
            return self.chunked(size, plan.seq or 0, plan.chunk_table, plan.chunk_key)
        if not plan.force_bootstrap:
            return plan.seq or 0
        if wanted and mode == "chunked":
            position, seq = self.reader.end(self.spark)
            self.hooks.started(capture, position)
            for d in self.router.deliveries:
                self.router.store.advance_cursor(self.router.pipeline, self.router.holder, d.sink.name, position, seq)
            self.router.commit()
            return self.chunked(size, seq)
        if wanted:
            return self.single(capture)
        self.hooks.started(capture)
        self.hooks.completed()
        return plan.seq or 0


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def work(spark: SparkSession, p: Pipeline, instance: str, store: ControlStore, metrics: Registry, checkpoint: str, available_now: bool = False):
    """What a leader does: bootstrap if need be, then one streaming query a sink, and commits beside them."""

    def lead(plan: Resume, lost: threading.Event) -> None:
        sinks = build_sinks(p.sinks)
        kind = lambda s: FrameDelivery if isinstance(s, MirrorSink) else Delivery
        deliveries = [kind(s)(p.id, instance, s, store, policy(c), metrics) for s, c in zip(sinks, p.sinks)]
        reader = build_reader(p.source)
        lag = (lambda: reader.lag_bytes(spark)) if hasattr(reader, "lag_bytes") else None
        router = Router(p.id, instance, store, deliveries, getattr(reader, "ack", None), metrics, lag)
        wanted, mode, size = snapshot_wish(p.source)
        hooks = SnapshotHooks(p.id, instance, store, metrics, mode)
        capture = capture_id(dataclasses.asdict(p.source))
        place = f"{checkpoint.rstrip('/')}/{p.id}/{uuid.uuid4().hex}"  # where to start is the control store's word, which is fenced
        over, queries, committer, failed = threading.Event(), [], None, []

        def watch() -> None:
            lost.wait()
            for d in deliveries:
                d.stop.set()

        threading.Thread(target=watch, daemon=True).start()
        try:
            start = Bootstrap(spark, reader, router, hooks, lost.is_set).begin(plan, wanted, mode, size, capture)
            log.info("leading %s (%s) after event %s", p.id, capture, start)
            own = {name: seq for name, _, seq in store.cursors(p.id)}

            def commit() -> None:
                try:
                    router.commit_until(over, max(float(p.commit_interval), 0.05))
                except Exception as e:  # noqa: BLE001  raised by the leader
                    failed.append(e)

            committer = threading.Thread(target=commit, daemon=True)
            committer.start()
            for d in deliveries:
                # A reader of its own: what it remembers between batches is this query's. A sink ahead of the others stays ahead.
                r = build_reader(p.source)
                stream = r.read_changes(spark, ReadRequest(seq=max(start, own.get(d.sink.name, 0))))
                q = stream.writeStream.queryName(f"{p.id}/{d.sink.name}/{uuid.uuid4().hex[:8]}").foreachBatch(lambda df, i, d=d, r=r: d.foreach_batch(r.decode(df), i)).option("checkpointLocation", f"{place}/{d.sink.name}")
                queries.append((q.trigger(availableNow=True) if available_now else q.trigger(processingTime=f"{max(p.commit_interval, 0.05)} seconds")).start())
            while not lost.wait(0.1) and not failed and any(q.isActive for q in queries) and not any(q.exception() for q in queries):
                pass
            if not lost.is_set():
                broken = [q.exception() for q in queries if q.exception()]
                if failed or broken:
                    raise failed[0] if failed else RuntimeError(str(broken[0]))
        except Stopped:
            if not lost.is_set():
                raise
        finally:
            for d in deliveries:
                d.stop.set()
            for q in queries:
                q.stop()
            over.set()
            if committer:
                committer.join()  # with the last commit
            router.close()
            if queries:
                _delete(spark, place)

    return lead


def run(spark: SparkSession, config: Config, checkpoint: str, stop: threading.Event | None = None) -> None:
    """Run all pipelines until stopped or told to by SIGINT or SIGTERM."""
    stop = stop or threading.Event()
    store, metrics, health = open_store(config.control_plane.dsn), Registry(), Health()
    if config.control_plane.auto_migrate:
        store.migrate()
    server = Server(config.observability.addr, metrics, health) if config.observability.addr else None
    if server:
        server.start()
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
    runners = [Runner(p.id, config.instance_id, store, work(spark, p, config.instance_id, store, metrics, checkpoint), float(config.control_plane.lease_ttl), float(config.control_plane.lease_renew), metrics, health) for p in config.pipelines]
    threads = [threading.Thread(target=r.run) for r in runners]
    for t in threads:
        t.start()
    stop.wait()
    for r in runners:
        r.stop()
    for t in threads:
        t.join()
    if server:
        server.stop()
    store.close()
