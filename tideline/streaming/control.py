"""The control store: who leads a pipeline, and how far everything in it has come, in SQLite.

Two tables. `terms` says who leads until when, and counts the terms. `marks` holds all
progress: one row a (pipeline, kind, name) with a log number and a JSON body. A mark is
put inside a transaction that first looks at the term, so an instance whose term is
over can't move anything.
"""

from __future__ import annotations

import json
import sqlite3
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

DDL = """
CREATE TABLE IF NOT EXISTS terms (pipeline TEXT PRIMARY KEY, number INTEGER NOT NULL, leader TEXT, until REAL);
CREATE TABLE IF NOT EXISTS marks (pipeline TEXT NOT NULL, kind TEXT NOT NULL, name TEXT NOT NULL, seq INTEGER NOT NULL, term INTEGER NOT NULL, body TEXT NOT NULL, PRIMARY KEY (pipeline, kind, name)) WITHOUT ROWID;
"""

#: Kinds of marks.
OFFSET, CURSOR, SNAPSHOT, PARKED = "offset", "cursor", "snapshot", "parked"


class LeaseLost(RuntimeError):
    """A write came from an instance whose term is over."""


class ControlStore:
    """Open with a file path, or for one process ':memory:' or '' (a temporary file). `now` is a parameter for tests."""

    def __init__(self, path: str):
        self.db = sqlite3.connect(path, check_same_thread=False, isolation_level=None, timeout=30)
        self.lock = threading.RLock()

    @contextmanager
    def _alone(self):
        """One writing transaction: no other connection writes between what it reads and what it puts."""
        with self.lock:
            self.db.execute("BEGIN IMMEDIATE")
            try:
                yield self.db
            except BaseException:
                self.db.execute("ROLLBACK")
                raise
            self.db.execute("COMMIT")

    def migrate(self) -> None:
        """Create what is missing; safe to repeat."""
        with self.lock:
            self.db.executescript(DDL)

    def close(self) -> None:
        self.db.close()

    # terms

    def _term(self, pipeline: str) -> tuple[int, str, float]:
        row = self.db.execute("SELECT number, leader, until FROM terms WHERE pipeline = ?", (pipeline,)).fetchone()
        return row or (0, "", float("-inf"))

    def acquire(self, pipeline: str, holder: str, ttl: float, now: float | None = None) -> bool:
        """Begin a term if nobody leads, or prolong one's own."""
        now = time.time() if now is None else now
        with self._alone() as db:
            number, leader, until = self._term(pipeline)
            own = leader == holder
            if not own and until >= now:
                return False
            number += not own or until < now
            db.execute("REPLACE INTO terms VALUES (?, ?, ?, ?)", (pipeline, number, holder, now + ttl))
            return True

    def release(self, pipeline: str, holder: str) -> None:
        """End one's own term at once."""
        with self._alone() as db:
            number, leader, _ = self._term(pipeline)
            if leader == holder:
                db.execute("REPLACE INTO terms VALUES (?, ?, '', -1)", (pipeline, number))

    def holder(self, pipeline: str, now: float | None = None) -> str:
        with self.lock:
            _, leader, until = self._term(pipeline)
        return leader if until >= (time.time() if now is None else now) else ""

    # marks

    @contextmanager
    def _leading(self, pipeline: str, holder: str, now: float | None):
        with self._alone() as db:
            number, leader, until = self._term(pipeline)
            if leader != holder or until < (time.time() if now is None else now):
                raise LeaseLost(f"{holder} doesn't lead {pipeline}")

            def put(kind: str, name: str, seq: int, **body) -> None:
                db.execute("REPLACE INTO marks VALUES (?, ?, ?, ?, ?, ?)", (pipeline, kind, name, seq, number, json.dumps(body)))

            yield put

    def _marks(self, pipeline: str, kind: str) -> list[tuple[str, int, dict]]:
        with self.lock:
            rows = self.db.execute("SELECT name, seq, body FROM marks WHERE pipeline = ? AND kind = ? ORDER BY name", (pipeline, kind)).fetchall()
        return [(name, seq, json.loads(body)) for name, seq, body in rows]

    def progress(self, pipeline: str) -> tuple[str, int] | None:
        """(position, seq) of the last event that every sink has."""
        found = self._marks(pipeline, OFFSET)
        return (found[0][2]["position"], found[0][1]) if found else None

    def load_offset(self, pipeline: str) -> str | None:
        found = self.progress(pipeline)
        return found[0] if found else None

    def save_offset(self, pipeline: str, holder: str, position: str, seq: int = 0, now: float | None = None) -> None:
        with self._leading(pipeline, holder, now) as put:
            put(OFFSET, "", seq, position=position)

    def advance_cursor(self, pipeline: str, holder: str, sink: str, position: str, seq: int, now: float | None = None) -> None:
        with self._leading(pipeline, holder, now) as put:
            put(CURSOR, sink, seq, position=position)

    def cursors(self, pipeline: str) -> list[tuple[str, str, int]]:
        """(sink, position, seq), by sink."""
        return [(name, body["position"], seq) for name, seq, body in self._marks(pipeline, CURSOR)]

    def snapshot_state(self, pipeline: str) -> dict | None:
        found = self._marks(pipeline, SNAPSHOT)
        return found[0][2] if found else None

    def begin_snapshot(self, pipeline: str, holder: str, mode: str = "single", slot: str = "", lsn: str = "", now: float | None = None) -> None:
        """A snapshot starts from nothing: what an earlier one had done is forgotten."""
        with self._leading(pipeline, holder, now) as put:
            put(SNAPSHOT, "", 0, phase="running", mode=mode or "single", slot_name=slot, consistent_lsn=lsn, chunk_table=None, chunk_key=None)

    def _change_snapshot(self, pipeline: str, holder: str, now: float | None, **changes) -> None:
        with self._leading(pipeline, holder, now) as put:
            put(SNAPSHOT, "", 0, **(self.snapshot_state(pipeline) or {}) | changes)

    def save_chunk(self, pipeline: str, holder: str, table: str, key: str, now: float | None = None) -> None:
        """key: JSON list of the last accepted row's key values as text, so no number loses digits."""
        self._change_snapshot(pipeline, holder, now, chunk_table=table, chunk_key=key)

    def complete_snapshot(self, pipeline: str, holder: str, lsn: str = "", now: float | None = None) -> None:
        self._change_snapshot(pipeline, holder, now, phase="done", **({"consistent_lsn": lsn} if lsn else {}))

    def dead_letter(self, pipeline: str, holder: str, sink: str, position: str, attempts: int, error: str, event: str, now: float | None = None) -> None:
        with self._leading(pipeline, holder, now) as put:
            last = self.db.execute("SELECT seq FROM marks WHERE pipeline = ? AND kind = ? ORDER BY name DESC LIMIT 1", (pipeline, PARKED)).fetchone()  # names sort as numbers do: one look at the key
            number = last[0] + 1 if last else 0
            put(PARKED, f"{number:012d}", number, sink=sink, position=position, attempts=attempts, error=error, event=event)

    def dead_letters(self, pipeline: str) -> list[tuple]:
        """(sink, position, attempts, error, event), oldest first."""
        return list(self.parked(pipeline))

    def parked(self, pipeline: str, page: int = 1000) -> Iterator[tuple]:
        """The same one after the other, read in pages."""
        after = ""
        while True:
            with self.lock:
                rows = self.db.execute("SELECT name, body FROM marks WHERE pipeline = ? AND kind = ? AND name > ? ORDER BY name LIMIT ?", (pipeline, PARKED, after, page)).fetchall()
            for after, text in rows:  # noqa: B007  the last name is where the next page begins
                body = json.loads(text)
                yield tuple(body[k] for k in ("sink", "position", "attempts", "error", "event"))
            if len(rows) < page:
                return
