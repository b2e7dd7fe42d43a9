"""Delivery: every sink has its own way through the log, with a bounded queue, retries, quarantine and a cursor."""

from __future__ import annotations

import math
import pickle
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import encoder
from .control import ControlStore, LeaseLost
from .observe import Registry
from .sinks import PAYLOAD, Sink, to_json

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass(frozen=True)
class Policy:
    """How a sink is served. max_attempts parks events; without it a batch is tried for ever."""

    batch_max_events: int = 500
    batch_max_wait: float = 0.2
    queue_size: int = 4096
    retry_initial: float = 0.25
    retry_max: float = 30.0
    dead_letter: bool = False
    max_attempts: int = 0


class Stopped(RuntimeError):
    """The pipeline was asked to stop before a batch was through."""


def encoded(df: DataFrame, encoding: str = "json") -> DataFrame:
    """Events as sinks take them: the payload is encoded in the JVM, and the commit time is a number, so no local time zone touches it."""
    build, _ = encoder(encoding)
    return df.select("*", build().alias(PAYLOAD)).withColumn("commit_ts", F.unix_micros("commit_ts"))


#: Events to a block, how blocks are compressed on their way to the driver, and events to a partition of them: the driver fetches these one by one.
BLOCK, CODEC, PART = 500, "zstd", 50_000


def _values(column: pa.Array) -> list:
    """A column's values as they stand in an event; a map is a dict."""
    kind = column.type
    if pa.types.is_map(kind):
        known: dict = {}
        keys, items, at = [known.setdefault(k, k) for k in _values(column.keys)], _values(column.items), column.offsets.to_numpy().tolist()
        return [dict(zip(keys[a:b], items[a:b])) if there else None for a, b, there in zip(at, at[1:], column.is_valid().to_numpy(zero_copy_only=False).tolist())]
    if pa.types.is_string(kind) or pa.types.is_integer(kind) and not column.null_count:  # by far the fastest way, and the same values
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist(maps_as_pydicts="strict")


class Columns(dict):
    """A block's events by column. Values are made where they are first asked for; its pickle is an Arrow stream."""

    def __init__(self, batch: pa.RecordBatch):
        super().__init__()
        self.batch, self.names = batch, batch.schema.names

    def __missing__(self, name: str) -> list:
        values = _values(self.batch.column(name))
        if name == "commit_ts":
            values = [None if v is None else EPOCH + timedelta(microseconds=v) for v in values]
        self[name] = values
        return values

    def __reduce__(self):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.batch.schema) as stream:
            stream.write_batch(self.batch)
        return _columns, (out.getvalue().to_pybytes(),)

    def events(self) -> list[Event]:
        return list(map(Event, repeat(self), range(self.batch.num_rows)))


def _columns(stream: bytes) -> Columns:
    return Columns(pa.ipc.open_stream(stream).read_next_batch())


class Event(Mapping):
    """One event of a block. It reads as the dict of its values and costs no more than those that are looked at."""

    __slots__ = ("_columns", "_at")

    def __init__(self, columns: Columns, at: int):
        self._columns, self._at = columns, at

    def __getitem__(self, name: str):
        return self._columns[name][self._at]

    def __iter__(self) -> Iterator[str]:
        return iter(self._columns.names)

    def __len__(self) -> int:
        return len(self._columns.names)

    def __repr__(self) -> str:
        return repr(dict(self))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs on the executors: events by blocks, as they come in Arrow, so neither side makes an object of a value that no sink looks at."""
    for batch in batches:
        texts = [pickle.dumps(Columns(batch.slice(i, BLOCK)), pickle.HIGHEST_PROTOCOL) for i in range(0, batch.num_rows, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(map(len, texts), pa.int64()), pa.array([pa.compress(t, CODEC, asbytes=True) for t in texts], pa.binary())], ["size", "block"])


def packed(df: DataFrame) -> DataFrame:
    """Blocks of the events of an encoded frame, in its order."""
    return df.mapInArrow(_blocks, "size long, block binary")


class Blocks:
    """Packed events that some readers go through, each at its own pace.

    A block is unpacked once for those that are near each other, so they get the same events, which none may change. At most NEAR bytes
    of blocks wait for the readers behind; one that falls further back unpacks for itself.
    """

    NEAR = 16_000_000

    def __init__(self, df: DataFrame, readers: int = 1):
        self.df, self.readers, self.lock = df, readers, threading.Lock()
        self.newest, self.near, self.bytes = -1, {}, 0  # by number: the block as it came, its events, its size, the readers that may still come

    def _drop(self, number: int) -> None:
        self.bytes -= self.near.pop(number)[2]

    def _events(self, number: int, block: bytes, size: int) -> list[Event]:
        unpack = lambda: pickle.loads(pa.decompress(block, size, CODEC, asbytes=True)).events()
        if self.readers < 2:
            return unpack()
        with self.lock:
            known = self.near.get(number)
            if known and known[0] == block:
                known[3] -= 1
                if not known[3]:
                    self._drop(number)
                return known[1]
            if number > self.newest:
                self.newest, events = number, unpack()
                self.near[number] = [block, events, size, self.readers - 1]
                self.bytes += size
                while self.bytes > self.NEAR:
                    self._drop(next(iter(self.near)))
                return events
        return unpack()

    def __iter__(self) -> Iterator[list[Event]]:
        """The events of each block, partition by partition."""
        for number, r in enumerate(self.df.toLocalIterator(prefetchPartitions=True)):
            yield self._events(number, bytes(r.block), r.size)


def rows(df: DataFrame) -> Iterator[Event]:
    """Events of an encoded frame in the order of seq, partition by partition."""
    return chain.from_iterable(Blocks(packed(df.orderBy("seq"))))


def in_ranges(df: DataFrame, most: int = PART) -> DataFrame:
    """df in the order of seq, by partitions of about `most` rows.

    Log numbers mostly lie evenly: equal stretches of them, found from seq alone, spare the pass over whole events that a range partitioning
    takes for its sample. Where a stretch would hold over twice its share, that is what deals them out.
    """
    n, low, high = df.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
    parts = max(1, math.ceil(n / most))
    dealt = df.repartitionByRange(parts, "seq")
    if n and low is not None and parts > 1:
        place = F.floor((F.col("seq").cast("double") - F.lit(float(low))) / F.lit(max(1.0, float(high) - float(low) + 1)) * parts)
        stretch = F.coalesce(F.least(place, F.lit(parts - 1)), F.lit(0)).cast("int")  # no number: first, as in every order
        if df.groupBy(stretch.alias("stretch")).count().agg(F.max("count")).first()[0] <= 2 * most:
            dealt = df.repartitionById(parts, stretch)
    return dealt.sortWithinPartitions("seq")


@contextmanager
def kept_blocks(df: DataFrame, *encodings: str) -> Iterator[dict[str, Blocks]]:
    """By encoding (one a reader), blocks of a frame's events in the order of seq, made by all executors at once and kept there meanwhile.

    A local iterator runs a job a partition, one after the other: what it reads must be ready, and can then be read by many.
    Events are sorted before they are encoded, so no payload is shuffled.
    """
    made: dict[str, Blocks] = {}
    try:
        ordered = in_ranges(df, PART) if encodings else None
        for encoding in encodings:
            if encoding not in made:
                made[encoding] = Blocks(packed(encoded(ordered, encoding)).persist(), encodings.count(encoding))
                made[encoding].df.count()
        yield made
    finally:
        for blocks in made.values():
            blocks.df.unpersist()


class Held:
    """At most size events (0: any number) between the thread that reads them and the one that delivers them.

    They pass in the lists they came in. The lock is only taken by who has to wait, and to wake them: the reader of the log once half the
    room is free, so the threads change places for thousands of events.
    """

    def __init__(self, size: int):
        self.size, self.lists, self.at, self.ended = size or math.inf, deque(), 0, False
        self.came, self.gone = 0, 0  # each is counted by one thread alone
        self.changed, self.full, self.idle = threading.Condition(), False, False

    def __len__(self) -> int:
        return self.came - self.gone

    def _wake(self) -> None:
        with self.changed:
            self.full = self.idle = False
            self.changed.notify_all()

    def put(self, event: dict, over: Callable[[], bool]) -> bool:
        """Whether it was taken before all was over."""
        return self.put_all([event], over)

    def put_all(self, events: list[dict], over: Callable[[], bool]) -> bool:
        """The same for many, as many at once as there is room for."""
        at = 0
        while at < len(events):
            room = min(self.size - len(self), len(events) - at)
            if room > 0:
                self.lists.append(events[at : at + room])
                self.came += room
                at += room
                if self.idle:
                    self._wake()
                continue
            if over():
                return False
            with self.changed:
                self.full = True
                if len(self) >= self.size:
                    self.changed.wait(0.1)
        return True

    def end(self) -> None:
        self.ended = True
        self._wake()

    def take(self, most: int, wait: float) -> list[dict]:
        """Up to `most` of the oldest; none if none came in time."""
        if not len(self) and not self.ended:
            with self.changed:
                self.idle = True
                if not len(self) and not self.ended:
                    self.changed.wait(wait)
        out, left = [], min(most, len(self))
        while left:
            some = self.lists[0][self.at : self.at + left]
            out += some
            left -= len(some)
            self.at += len(some)
            self.gone += len(some)
            if self.at == len(self.lists[0]):
                self.lists.popleft()
                self.at = 0
        if self.full and 2 * len(self) <= self.size:
            self._wake()
        return out


class Delivery:
    """One sink's way through the log: ordered batches, each accepted or parked before the next.

    Between the log and the sink stands a queue of at most queue_size events: a slow sink
    stops its own reading and nothing else. A batch is closed when it has batch_max_events,
    or batch_max_wait seconds after its first event.
    """

    def __init__(self, pipeline: str, holder: str, sink: Sink, store: ControlStore, policy: Policy = Policy(), metrics: Registry | None = None, sleep: Callable[[float], bool] | None = None):
        self.pipeline, self.holder, self.sink, self.store, self.policy = pipeline, holder, sink, store, policy
        self.metrics = metrics or Registry()
        self.stop = threading.Event()
        self.sleep = sleep or self.stop.wait
        self.labels = {"pipeline": pipeline, "sink": sink.name}

    def _try(self, events: Sequence[dict], limit: int) -> Exception | None:
        """Write with capped exponential backoff; the last error once limit attempts (0: none) have failed."""
        delay, attempt = self.policy.retry_initial, 0
        while True:
            attempt += 1
            try:
                self.sink.write(events)
                self.metrics.add("tideline_batches_written_total", **self.labels)
                self.metrics.add("tideline_events_written_total", len(events), **self.labels)
                return None
            except Exception as e:  # noqa: BLE001  any failure of a sink is tried again
                self.metrics.add("tideline_write_failures_total", **self.labels)
                if limit and attempt >= limit:
                    return e
            if self.sleep(delay) or self.stop.is_set():
                raise Stopped(self.sink.name)
            delay = min(delay * 2, self.policy.retry_max)

    def _park(self, event: dict, error: Exception) -> None:
        try:
            text = to_json(event)
        except (TypeError, ValueError) as e:
            text = f'{{"unencodable": "{type(e).__name__}"}}'
        self.store.dead_letter(self.pipeline, self.holder, self.sink.name, event["position"], self.policy.max_attempts, str(error), text)
        self.metrics.add("tideline_dead_lettered_total", **self.labels)

    def batch(self, events: Sequence[dict]) -> None:
        """Deliver one batch. If it fails for good, its events go one by one, and only those that fail are parked."""
        limit = self.policy.max_attempts if self.policy.dead_letter else 0
        error = self._try(events, limit)
        if error is None:
            return
        if len(events) == 1:
            self._park(events[0], error)
            return
        for e in events:
            if (one := self._try([e], 1)) is not None:
                self._park(e, one)

    def run(self, events: Iterable[dict], cursor: bool = True) -> int:
        """All events in order, in batches; the cursor follows each. The number of events."""
        return self.run_lists(([e] for e in events), cursor)

    def run_lists(self, lists: Iterable[list[dict]], cursor: bool = True) -> int:
        """The same for events that come in lists."""
        held, over, failed = Held(self.policy.queue_size), threading.Event(), []
        ended = lambda: over.is_set() or self.stop.is_set()

        def feed() -> None:
            try:
                for some in lists:
                    if ended() or not held.put_all(some, ended):
                        return
            except BaseException as e:  # noqa: BLE001  raised again below
                failed.append(e)
            finally:
                held.end()

        feeder = threading.Thread(target=feed, daemon=True)
        feeder.start()
        done = 0
        try:
            for batch in self._batches(held):
                self.batch(batch)
                done += len(batch)
                if cursor:
                    self.store.advance_cursor(self.pipeline, self.holder, self.sink.name, batch[-1]["position"], batch[-1]["seq"])
            if failed:
                raise failed[0]
            return done
        finally:
            over.set()
            feeder.join()
            self.metrics.set("tideline_queue_events", 0, **self.labels)

    def _batches(self, held: Held) -> Iterator[list[dict]]:
        """What the queue holds, cut by number and by time; ends with the events."""
        batch: list[dict] = []
        due = 0.0
        while True:
            self.metrics.set("tideline_queue_events", len(held), **self.labels)
            if self.stop.is_set():
                raise Stopped(self.sink.name)
            over = held.ended
            got = held.take(self.policy.batch_max_events - len(batch), min(0.1, max(due - time.monotonic(), 0)) if batch else 0.1)
            if got and not batch:
                due = time.monotonic() + self.policy.batch_max_wait
            batch += got
            if batch and (len(batch) >= self.policy.batch_max_events or not got and (over or time.monotonic() >= due)):
                yield batch
                batch = []
            elif over and not got:
                return

    @property
    def encoding(self) -> str:
        return getattr(self.sink, "encoding", "json")

    def serve(self, df: DataFrame, cursor: bool = True) -> int:
        """All events of a batch frame. Sinks of this kind are single ordered consumers; a mirror kept as a table is folded in place instead."""
        with kept_blocks(df, self.encoding) as blocks:
            return self.take(df, blocks, cursor)

    def take(self, df: DataFrame, blocks: dict[str, Blocks], cursor: bool = True) -> int:
        """The same from the frame's kept blocks, which all sinks of an encoding share."""
        return self.run_lists(blocks[self.encoding], cursor)

    def foreach_batch(self, df: DataFrame, batch_id: int) -> None:
        """For writeStream.foreachBatch of a query of the sink's own."""
        n = self.serve(df)
        self.metrics.add("tideline_events_read_total", n, **self.labels)
        self.metrics.add("tideline_microbatches_total", **self.labels)


class Frame:
    """A batch frame in the place of a list of events."""

    def __init__(self, df: DataFrame, n: int):
        self.df, self.n = df, n

    def __len__(self) -> int:
        return self.n


class FrameDelivery(Delivery):
    """The way of a sink that takes whole frames: nothing passes through the driver but a count and the last position."""

    def take(self, df: DataFrame, blocks: dict[str, Blocks], cursor: bool = True) -> int:
        return self.serve(df, cursor)

    def serve(self, df: DataFrame, cursor: bool = True) -> int:
        n, seq, position = df.agg(F.count("*"), F.max("seq"), F.max_by("position", "seq")).first()
        if n:
            self._try(Frame(df, n), 0)
            if cursor:
                self.store.advance_cursor(self.pipeline, self.holder, self.sink.name, position, seq)
        return n


class Router:
    """Commits what all sinks have. Each of them has a query and a cursor of its own, so none waits for another."""

    def __init__(self, pipeline: str, holder: str, store: ControlStore, deliveries: Sequence[Delivery], ack: Callable[[str], None] | None = None, metrics: Registry | None = None, lag: Callable[[], int | None] | None = None):
        self.pipeline, self.holder, self.store, self.deliveries = pipeline, holder, store, list(deliveries)
        self.ack, self.metrics, self.lag = ack, metrics or Registry(), lag
        self.committed: str | None = None

    def commit(self) -> str | None:
        """Save the slowest cursor if it moved: never while a sink has delivered nothing."""
        names = {d.sink.name for d in self.deliveries}
        cursors = [c for c in self.store.cursors(self.pipeline) if c[0] in names and c[2] > 0]
        if not cursors:
            return None
        newest = max(c[2] for c in cursors)
        self.metrics.set("tideline_newest_seq", newest, pipeline=self.pipeline)
        if len(cursors) < len(names):
            return None
        _, position, seq = min(cursors, key=lambda c: c[2])
        self.metrics.set("tideline_committed_seq", seq, pipeline=self.pipeline)
        self.metrics.set("tideline_lag_events", newest - seq, pipeline=self.pipeline)
        if (position, seq) != self.committed:
            self.store.save_offset(self.pipeline, self.holder, position, seq)
            self.committed = position, seq
            self.metrics.add("tideline_offset_commits_total", pipeline=self.pipeline)
            if self.ack:
                self.ack(position)
            if self.lag and (lag := self.lag()) is not None:
                self.metrics.set("tideline_source_lag_bytes", lag, pipeline=self.pipeline)
        return position

    def commit_until(self, over: threading.Event, interval: float) -> None:
        """Commit every interval seconds, and once more when all is over. A lost lease ends it; other errors pass."""
        while True:
            last = over.wait(interval)
            try:
                self.commit()
            except LeaseLost:
                raise
            except Exception:  # noqa: BLE001  the store may be away for a while
                if last:
                    raise
            if last:
                return

    def serve(self, df: DataFrame, cursor: bool = True) -> None:
        """A batch frame to all sinks, side by side; the first error once all have ended. It is sorted and encoded once for all that read events."""
        errors: list[Exception] = []

        def one(d: Delivery, blocks: dict[str, Blocks]) -> None:
            try:
                d.take(df, blocks, cursor)
            except Exception as e:  # noqa: BLE001  reported below
                errors.append(e)

        with kept_blocks(df, *[d.encoding for d in self.deliveries if not isinstance(d, FrameDelivery)]) as blocks:
            threads = [threading.Thread(target=one, args=(d, blocks)) for d in self.deliveries]
            for t in threads:
                t.start()
            for t in threads:
                t.join()
        lost = [e for e in errors if isinstance(e, LeaseLost)]
        if errors:
            raise (lost or errors)[0]

    def foreach_batch(self, df: DataFrame, batch_id: int) -> None:
        """For one query that feeds all sinks; a slow one holds the others up. service.work gives each a query instead."""
        self.metrics.add("tideline_events_read_total", df.count(), pipeline=self.pipeline)
        self.serve(df)
        self.commit()

    def close(self) -> None:
        for d in self.deliveries:
            d.stop.set()
            d.sink.close()


def wait_until(done: Callable[[], bool], timeout: float, step: float = 0.05) -> bool:
    end = time.monotonic() + timeout
    while time.monotonic() < end:
        if done():
            return True
        time.sleep(step)
    return done()
