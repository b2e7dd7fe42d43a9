"""Sinks: they take an ordered batch of events, all or an error, and may see a batch again. Several may get the same events, so none changes them."""

from __future__ import annotations

import base64
import hashlib
import json
import queue
import re
import subprocess
import sys
import threading
import urllib.error
import urllib.request
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from typing import Protocol

from ..functions.encoding import CONTENT_TYPES, encode_message, encoder

Event = Mapping


class Sink(Protocol):
    name: str

    def write(self, events: Sequence[Event]) -> None: ...

    def close(self) -> None: ...


#: Where the log's own encoding of an event travels with it: see functions.encoding.
PAYLOAD = "payload"


def _time(ts: datetime | None) -> str:
    """RFC 3339; a time without zone is taken as UTC."""
    if ts is None:
        return "0001-01-01T00:00:00Z"
    ts = ts if ts.tzinfo is None else ts.astimezone(timezone.utc).replace(tzinfo=None)
    return ts.strftime("%Y-%m-%dT%H:%M:%S.%f").rstrip("0").rstrip(".") + "Z"


def to_json(event: Event) -> str:
    """The event as json_event wrote it in the JVM; an event that doesn't come from a stream is written by the same rules."""
    if isinstance(event.get(PAYLOAD), str):
        return event[PAYLOAD]
    out = {k: event[k] for k in ("source_id", "schema", "table", "op")}
    out |= {k: dict(sorted(event[k].items())) for k in ("before", "after") if event.get(k)}
    out |= {"position": event["position"], "commit_ts": _time(event.get("commit_ts"))}
    text = json.dumps(out, ensure_ascii=False, separators=(",", ":"), default=str)
    return text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")


def to_bytes(event: Event, encoding: str) -> bytes:
    if encoding == "json":
        return to_json(event).encode()
    found = event.get(PAYLOAD)
    return bytes(found) if isinstance(found, (bytes, bytearray)) else encode_message(dict(event))


def qualified(event: Event) -> str:
    return f"{event['schema']}.{event['table']}" if event["schema"] else event["table"]


def idempotency_key(event: Event) -> str:
    return f"{event['source_id']}|{qualified(event)}|{event['position']}"


def batch_id(events: Sequence[Event]) -> str:
    """source|first position|last position."""
    return f"{events[0]['source_id']}|{events[0]['position']}|{events[-1]['position']}"


def _with_events(head: dict, events: Sequence[str]) -> str:
    """head as a JSON object, and a list of JSON texts as its last field."""
    return json.dumps(head, ensure_ascii=False)[:-1] + ', "events": [' + ",".join(events) + "]}"


class StdoutSink:
    """One JSON line per event; lines of several threads don't mix."""

    lock = threading.Lock()

    def __init__(self, name: str, stream=None):
        self.name, self.stream = name, stream or sys.stdout

    def write(self, events: Sequence[Event]) -> None:
        text = "".join(to_json(e) + "\n" for e in events)
        with self.lock:
            self.stream.write(text)
            self.stream.flush()

    def close(self) -> None:
        pass


class WebhookSink:
    """POST of a JSON envelope; configured headers win, and any answer but 2xx is an error with its head."""

    def __init__(self, name: str, url: str, headers: Mapping[str, str] | None = None, timeout: float = 30):
        self.name, self.url, self.headers, self.timeout = name, url, dict(headers or {}), timeout

    def write(self, events: Sequence[Event]) -> None:
        if not events:
            return
        head = {"source_id": events[0]["source_id"], "count": len(events), "first_position": events[0]["position"], "last_position": events[-1]["position"]}
        body = _with_events(head, [to_json(e) for e in events])
        headers = {"Content-Type": "application/json", "Idempotency-Key": batch_id(events)} | self.headers
        request = urllib.request.Request(self.url, body.encode(), headers, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                if not 200 <= r.status < 300:
                    raise RuntimeError(f"webhook {self.name}: status {r.status}: {r.read(512)!r}")
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"webhook {self.name}: status {e.code}: {e.read(512)!r}") from e

    def close(self) -> None:
        pass


class ProcessSink:
    """A child process that reads a JSON request a line and answers a JSON line {ok, error}.

    It starts with the first batch. One that answers not in time is killed at once; on closing
    it gets grace seconds after its input ends. With restart_on_error a refused batch ends
    it too.
    """

    def __init__(self, name: str, command: Sequence[str], cwd: str | None = None, env: Mapping[str, str] | None = None, timeout: float = 60, restart_on_error: bool = False, encoding: str = "json", grace: float = 5):
        if not command:
            raise ValueError(f"process sink {name} needs a command")
        self.name, self.command, self.cwd, self.env = name, list(command), cwd, env
        self.timeout, self.restart, self.grace = timeout, restart_on_error, grace
        encoder(encoding)
        self.encoding, self.child, self.answers = encoding, None, None

    def _start(self) -> None:
        import os

        self.child = subprocess.Popen(self.command, cwd=self.cwd, env=os.environ | dict(self.env or {}), stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
        self.answers = queue.Queue()

        def read(child=self.child, out=self.answers):
            for line in child.stdout:
                out.put(line)
            out.put(None)

        threading.Thread(target=read, daemon=True).start()

    def _kill(self) -> None:
        if self.child:
            self.child.kill()
            self.child.wait()
        self.child = None

    def write(self, events: Sequence[Event]) -> None:
        if not events:
            return
        if self.child is None or self.child.poll() is not None:
            self._start()
        binary = lambda e: json.dumps(base64.b64encode(to_bytes(e, self.encoding)).decode())
        request = _with_events({"batch_id": batch_id(events), "count": len(events)}, [to_json(e) if self.encoding == "json" else binary(e) for e in events])
        try:
            self.child.stdin.write(request + "\n")
            self.child.stdin.flush()
            line = self.answers.get(timeout=self.timeout)
        except queue.Empty:
            self._kill()
            raise TimeoutError(f"process sink {self.name}: no answer in {self.timeout} s") from None
        except OSError as e:
            self._kill()
            raise RuntimeError(f"process sink {self.name}: {e}") from e
        if line is None:
            self._kill()
            raise RuntimeError(f"process sink {self.name}: the process ended without an answer")
        try:
            answer = json.loads(line)
        except ValueError:
            self._kill()
            raise RuntimeError(f"process sink {self.name}: not an answer: {line[:200]!r}") from None
        if not answer.get("ok"):
            if self.restart:
                self._kill()
            raise RuntimeError(f"process sink {self.name}: {answer.get('error') or 'refused'}")

    def close(self) -> None:
        if self.child and self.child.poll() is None:
            self.child.stdin.close()
            try:
                self.child.wait(self.grace)
            except subprocess.TimeoutExpired:
                self._kill()
        self.child = None


class UpsertSink:
    """Applies events to tables over a DB-API connection, one transaction a batch.

    Statements use the form of PostgreSQL and SQLite: INSERT ... ON CONFLICT. An upsert sets
    only columns the event holds. Rows are found by the configured keys.
    """

    def __init__(self, name: str, connection, keys: Mapping[str, Sequence[str]], schema: str | None = None, soft_delete: bool = False, deleted_column: str = "_deleted_at", mark: str = "?", now: str = "CURRENT_TIMESTAMP"):
        self.name, self.db, self.keys, self.schema = name, connection, keys, schema
        self.soft, self.deleted, self.mark, self.now = soft_delete, deleted_column, mark, now

    @staticmethod
    def quote(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def _target(self, e: Event) -> str:
        schema = self.schema if self.schema is not None else e["schema"]
        return (self.quote(schema) + "." if schema else "") + self.quote(e["table"])

    def statement(self, e: Event) -> tuple[str, list]:
        q, target = self.quote, self._target(e)
        if e["op"] == "t":
            return (f"UPDATE {target} SET {q(self.deleted)} = {self.now} WHERE {q(self.deleted)} IS NULL" if self.soft else f"DELETE FROM {target}"), []
        keys = self.keys.get(qualified(e)) or self.keys.get(e["table"])
        if not keys:
            raise ValueError(f"no key columns for {qualified(e)}")
        image = e.get("before" if e["op"] == "d" else "after") or {}
        if not image:
            raise ValueError(f"{e['op']} on {qualified(e)} has no {'before' if e['op'] == 'd' else 'after'} image")
        for k in keys:
            if k not in image:
                raise ValueError(f"{e['op']} on {qualified(e)} is missing key column {k}")
        if e["op"] == "d":
            where = " AND ".join(f"{q(k)} = {self.mark}" for k in keys)
            head = f"UPDATE {target} SET {q(self.deleted)} = {self.now}" if self.soft else f"DELETE FROM {target}"
            return f"{head} WHERE {where}", [image[k] for k in keys]
        cols = sorted(image)
        sets = [f"{q(c)} = excluded.{q(c)}" for c in cols if c not in keys] + [f"{q(self.deleted)} = NULL"] * self.soft
        action = "DO UPDATE SET " + ", ".join(sets) if sets else "DO NOTHING"
        return f"INSERT INTO {target} ({', '.join(map(q, cols))}) VALUES ({', '.join([self.mark] * len(cols))}) ON CONFLICT ({', '.join(map(q, keys))}) {action}", [image[c] for c in cols]

    def write(self, events: Sequence[Event]) -> None:
        cursor = self.db.cursor()
        try:
            for e in events:
                cursor.execute(*self.statement(e))
            self.db.commit()
        except BaseException:
            self.db.rollback()
            raise

    def close(self) -> None:
        self.db.close()


def message_id(event: Event) -> str:
    """What tells an event from every other: the idempotency key, the op, the row and the log number.

    Rows of a snapshot, chunk or transaction share a position, so a broker that drops repeats of the bare
    idempotency key would drop rows; an event that is sent again keeps its log number.
    """
    image = event.get("after") or event.get("before") or {}
    row = ",".join(f"{k}={v}" for k, v in sorted(image.items()))
    return "|".join([idempotency_key(event), event["op"], hashlib.sha256(row.encode()).hexdigest()[:16], str(event["seq"])])


class MirrorSink:
    """Mirrors of tables kept as versioned Parquet (streaming.mirror), folded where the frames lie. Events of other tables pass."""

    def __init__(self, name: str, path: str, tables: Mapping[str, tuple[Sequence[str], Mapping[str, str]]], buckets: int = 16):
        if not path or not tables:
            raise ValueError(f"mirror sink {name} needs a path and tables")
        self.name, self.path, self.tables, self.buckets = name, path.rstrip("/"), dict(tables), buckets

    def mirror(self, spark, table: str):
        from .mirror import Mirror

        keys, columns = self.tables[table]
        return Mirror(spark, f"{self.path}/{table}", keys, columns, self.buckets)

    def write(self, frame) -> None:
        from ..model import qualified as name

        for table in self.tables:
            self.mirror(frame.df.sparkSession, table).apply(frame.df.where(name() == table))

    def close(self) -> None:
        pass


class BrokerSink:
    """Messages for a broker through a client's publish(topic, key, value, headers) and flush()."""

    def __init__(self, name: str, client, topic, key=None, encoding: str = "json", header_prefix: str = "tideline", id_header: str | None = None):
        encoder(encoding)
        self.name, self.client, self.topic, self.key, self.id_header = name, client, topic, key, id_header
        self.encoding, self.prefix = encoding, header_prefix

    def message(self, e: Event) -> dict:
        headers = {f"{self.prefix}-op": e["op"], f"{self.prefix}-source": e["source_id"], f"{self.prefix}-position": e["position"], "idempotency-key": idempotency_key(e), "content-type": CONTENT_TYPES[self.encoding]}
        if self.id_header:
            headers[self.id_header] = message_id(e)
        return {"topic": self.topic(e), "key": self.key(e) if self.key else None, "value": to_bytes(e, self.encoding), "headers": headers}

    def write(self, events: Sequence[Event]) -> None:
        """Publish all, then wait for all; one that isn't acknowledged fails the batch."""
        for e in events:
            self.client.publish(**self.message(e))
        self.client.flush()

    def close(self) -> None:
        close = getattr(self.client, "close", None)
        if close:
            close()


#: Fixed value: the header by which the broker knows a repeated message.
NATS_ID = "Nats-Msg-Id"


class NatsSink(BrokerSink):
    """Messages on NATS subjects over a connection.

    With a stream, up to max_pending messages wait for their acknowledgements at a time, each
    ack_wait seconds at most, and one that doesn't come fails the batch. In core mode there are none: a batch
    counts once the server has taken all that was written (flush), so it may be lost there.
    The connection: publish(subject, payload, headers) returns a future with a stream and nothing
    in core mode; flush(timeout).
    """

    def __init__(self, name: str, connection, prefix: str = "", core_only: bool = False, max_pending: int = 256, ack_wait: float = 30, encoding: str = "json"):
        super().__init__(name, connection, lambda e: subject(prefix, e), None, encoding, id_header=NATS_ID)
        self.core, self.max_pending, self.ack_wait = core_only, max_pending, ack_wait

    def write(self, events: Sequence[Event]) -> None:
        pending: list = []
        for e in events:
            m = self.message(e)
            sent = self.client.publish(m["topic"], m["value"], m["headers"])
            if not self.core:
                pending.append((e["position"], sent))
                if len(pending) >= self.max_pending:
                    self._acknowledged(pending)
        self._acknowledged(pending)
        if self.core:
            self.client.flush(self.ack_wait)

    def _acknowledged(self, pending: list) -> None:
        missing = []
        for position, sent in pending:
            try:
                sent.result(self.ack_wait)
            except Exception as e:  # noqa: BLE001  whatever keeps an acknowledgement away
                missing.append(f"{position}: {e or type(e).__name__}")
        pending.clear()
        if missing:
            raise RuntimeError(f"nats {self.name}: {len(missing)} messages without acknowledgement, first {missing[0]}")


def subject(prefix: str, event: Event) -> str:
    """prefix.schema.table; characters with a meaning in subjects become '_' in the last two."""
    clean = [re.sub("[.*> ]", "_", event[k]) for k in ("schema", "table") if event[k]]
    return ".".join([prefix, *clean] if prefix else clean)


def topic(prefix: str, fixed: str, event: Event) -> str:
    """The fixed topic if there is one, else prefix.schema.table in the characters a topic may have."""
    return fixed or re.sub("[^A-Za-z0-9._-]", "_", ".".join(x for x in (prefix, event["schema"], event["table"]) if x))


def partition_key(keys: Mapping[str, Sequence[str]], event: Event) -> str:
    """table|key|...; a value that is missing or NULL reads <nil>."""
    cols = keys.get(qualified(event)) or keys.get(event["table"]) or []
    image = event.get("after") or event.get("before") or {}
    return "|".join([qualified(event), *["<nil>" if image.get(k) is None else str(image[k]) for k in cols]])
