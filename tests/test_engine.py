"""Parts of the engine on awkward rows: folds, windows, mirrors, bootstraps, statements."""

import json
import os
import sqlite3
import subprocess
import sys
import threading
import time
from concurrent.futures import Future
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tideline import cli
from tideline.config import Source
from tideline.functions.encoding import json_event
from tideline.model import SCHEMA
from tideline.operators import apply, snapshot
from tideline.sources import mysql, postgres
from tideline.sources.base import ReadRequest, build_reader
from tideline.sources.changelog import COLUMNS, KEYS, change_log
from tideline.streaming.control import ControlStore, LeaseLost
from tideline.streaming.delivery import Delivery, Policy, Router, encoded, rows, wait_until
from tideline.streaming.mirror import Mirror
from tideline.streaming.sinks import NatsSink, message_id, to_json

T0 = datetime(2024, 1, 2, 3, 4, 5, 600000, tzinfo=timezone.utc)


def log(spark, events):
    """events: (seq, op, id, {column: value})."""
    out = []
    for seq, op, id_, rest in events:
        image = {"id": id_, **rest} if id_ is not None else None
        out.append((seq, "s", "public", "t", op, image if op == "d" else None, image if op in "cur" else None, f"0/{seq:X}", T0 + timedelta(seconds=seq)))
    return spark.createDataFrame(out, SCHEMA)


def state(df):
    return {r.id: (r.a, r.b, r.last_seq) for r in df.collect()}


COLS = {"id": "string", "a": "string", "b": "string"}


@pytest.fixture
def mirror(spark, tmp_path):
    return Mirror(spark, str(tmp_path / "m"), ["id"], COLS, 3)


def test_mirror_keeps_a_number_a_column(spark, mirror):
    mirror.apply(log(spark, [(5, "u", "1", {"a": "new"})]), 0)
    mirror.apply(log(spark, [(3, "c", "1", {"a": "old", "b": "kept"})]), 1)
    assert state(mirror.current()) == {"1": ("new", "kept", 5)}


def test_mirror_remembers_the_deleted(spark, mirror):
    mirror.apply(log(spark, [(3, "c", "1", {"a": "x"}), (5, "d", "1", {})]), 0)
    mirror.apply(log(spark, [(4, "u", "1", {"a": "late"})]), 1)
    assert state(mirror.current()) == {}
    mirror.apply(log(spark, [(6, "c", "1", {"b": "again"})]), 2)
    assert state(mirror.current()) == {"1": (None, "again", 6)}


def test_mirror_takes_batches_of_a_new_checkpoint(spark, mirror):
    mirror.apply(log(spark, [(1, "c", "1", {"a": "x"})]), 7)
    mirror.apply(log(spark, [(2, "c", "2", {"a": "y"})]), 0)
    mirror.apply(log(spark, [(2, "c", "2", {"a": "y"}), (1, "c", "1", {"a": "x"})]), 0)
    assert state(mirror.current()) == {"1": ("x", None, 1), "2": ("y", None, 2)}


def test_mirror_truncates_and_compacts(spark, mirror, tmp_path):
    mirror.apply(log(spark, [(i, "c", str(i), {"a": "x"}) for i in range(1, 9)] + [(20, "d", "8", {})]))
    mirror.apply(log(spark, [(30, "t", None, {})]))
    mirror.apply(log(spark, [(29, "u", "3", {"a": "late"}), (31, "c", "4", {"a": "y"})]))
    assert state(mirror.current()) == {"4": ("y", None, 31)}
    stored = mirror._rows(mirror._pointer()).count()
    mirror.compact(31)
    assert mirror._rows(mirror._pointer()).count() == 1 < stored and state(mirror.current()) == {"4": ("y", None, 31)}
    mirror.apply(log(spark, [(29, "u", "3", {"a": "late"})]))
    assert state(mirror.current()) == {"4": ("y", None, 31)}
    assert len(os.listdir(tmp_path / "m" / "pointer")) <= 2 * 2  # with checksum files


def test_first_after(spark):
    rng_rows = [(i,) for i in range(0, 5000, 7)]
    marks = [(i, T0) for i in range(3, 4000, 191)]
    df = apply.first_after(spark.createDataFrame(rng_rows, "last_seq long"), spark.createDataFrame(marks, "seq long, commit_ts timestamp"))
    for r in df.collect():
        want = next((s for s, _ in marks if s > r.last_seq), None)
        assert (r._next.seq if r._next else None) == want


@pytest.mark.parametrize("few", [0, 10**6])
def test_windows(spark, monkeypatch, few):
    """Marks met by ranges of log numbers hold what a plain comparison finds."""
    monkeypatch.setattr(snapshot, "FEW_CHUNKS", few)
    monkeypatch.setattr(snapshot, "RANGE", 16)
    points = spark.createDataFrame([(i,) for i in (1, 2, 40, 41, 300, 5000)], "seq long")
    windows = [(0, 0, 1), (1, 1, 40), (2, 39, 310), (3, 400, 4999), (4, 4990, 6000), (5, 41, 42)]
    plan = spark.createDataFrame(windows, "chunk long, lw long, hw long")
    got = {(r.seq, r.chunk) for r in snapshot._in_windows(points, plan, "lw", "hw").collect()}
    assert got == {(s, c) for s in (1, 2, 40, 41, 300, 5000) for c, lo, hi in windows if lo < s <= hi}
    last = {r.chunk: r.s for r in snapshot._in_windows(points, plan, None, "hw").groupBy("chunk").agg(F.max("seq").alias("s")).collect()}
    assert last == {c: max(s for s in (1, 2, 40, 41, 300, 5000) if s <= hi) for c, _, hi in windows}


def test_marks(spark):
    w = lambda seq, kind, chunk, prefix="me": (seq, "s", "", "", "w", None, {"prefix": prefix, "kind": kind, "chunk": str(chunk)}, "", None)
    d = spark.createDataFrame([w(1, "low", 0), w(2, "low", 0, "you"), w(5, "low", 0), w(6, "high", 0, "you"), w(7, "high", 1), w(8, "high", 0), w(9, "high", 0), w(10, "low", 1)], SCHEMA)
    assert [tuple(r) for r in snapshot.marks(d, "me").collect()] == [(0, 5, 8)] and snapshot.without_marks(d).count() == 0


ODD = {"id": "1", "a": 'é <b> & "q" \\ \n\t  \x01 /', "b": None}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_one_text_in_any_zone(spark, zone):
    """What a sink sends is what json_event says, and hand-made events are written by the same rules."""
    df = log(spark, [(1, "c", "1", {k: v for k, v in ODD.items() if k != "id"}), (2, "d", "1", {}), (3, "t", None, {})])
    want = [r.j for r in df.orderBy("seq").select(json_event().alias("j")).collect()]
    before = os.environ.get("TZ")
    os.environ["TZ"] = zone
    time.tzset()
    try:
        events = list(rows(encoded(df)))
        assert [to_json(e) for e in events] == want and events[0]["commit_ts"] == T0 + timedelta(seconds=1)
        plain = [to_json({k: v for k, v in e.items() if k != "payload"}) for e in events]
        assert [json.loads(x) for x in plain] == [json.loads(x) for x in want] and "<" not in plain[0] and plain[1:] == want[1:]
    finally:
        os.environ.pop("TZ") if before is None else os.environ.__setitem__("TZ", before)
        time.tzset()


def test_shared_positions(spark, tmp_path):
    """A run that ends inside a position goes on with the next event; by the position alone it begins the position again."""
    d = log(spark, [(i, "c", str(i), {}) for i in range(1, 11)]).withColumn("position", F.lit("0/1"))
    d.coalesce(1).write.parquet(str(tmp_path / "log"))
    config = Source("changelog", "s")
    config.changelog.path = str(tmp_path / "log")
    r = build_reader(config)
    assert r.starts_after(spark, ReadRequest("0/1", 4)) == 4 and r.starts_after(spark, ReadRequest("0/1")) == 0 and r.starts_after(spark, ReadRequest()) == 0
    with pytest.raises(ValueError, match="no position"):
        r.starts_after(spark, ReadRequest("0/7"))


class Slow:
    name = "slow"

    def __init__(self):
        self.free, self.got, self.sizes = threading.Event(), [], []

    def write(self, events):
        self.free.wait(20)
        self.got += events
        self.sizes.append(len(events))

    def close(self):
        pass


@pytest.fixture
def store():
    s = ControlStore(":memory:")
    s.migrate()
    s.acquire("p", "me", 600)
    yield s
    s.close()


def event(seq):
    return {"seq": seq, "source_id": "s", "schema": "public", "table": "t", "op": "c", "before": None, "after": {"id": str(seq)}, "position": f"0/{seq:X}", "commit_ts": None}


def test_queue_is_bounded(store):
    """A sink that stands still holds back its source: the queue, a batch in hand and one event on the way."""
    sink, read = Slow(), []

    def source():
        for i in range(1, 200):
            read.append(i)
            yield event(i)

    d = Delivery("p", "me", sink, store, Policy(batch_max_events=5, queue_size=10))
    t = threading.Thread(target=d.run, args=(source(),))
    t.start()
    time.sleep(1)
    assert len(read) <= 10 + 5 + 1 and d.metrics.get("tideline_queue_events", pipeline="p", sink="slow") <= 10
    sink.free.set()
    t.join(30)
    assert [e["seq"] for e in sink.got] == list(range(1, 200)) and max(sink.sizes) == 5


def test_a_batch_waits_only_so_long(store):
    sink = Slow()
    sink.free.set()

    def source():
        for i in (1, 2):
            yield event(i)
        wait_until(lambda: sink.sizes, 10)
        yield event(3)

    Delivery("p", "me", sink, store, Policy(batch_max_wait=0.2)).run(source())
    assert sink.sizes == [2, 1]


def test_last_commit_on_stop(store):
    d = Delivery("p", "me", Slow(), store)
    d.sink.free.set()
    r, over = Router("p", "me", store, [d]), threading.Event()
    t = threading.Thread(target=r.commit_until, args=(over, 60))
    t.start()
    d.run([event(i) for i in range(1, 6)])
    assert store.progress("p") is None
    over.set()
    t.join(10)
    assert store.progress("p") == ("0/5", 5) and r.metrics.get("tideline_committed_seq", pipeline="p") == 5
    store.acquire("q", "other", 600)
    lost = Router("q", "me", store, [d])
    store.db.execute("insert into marks values ('q', 'cursor', 'slow', 5, 1, '{\"position\": \"0/5\"}')")
    with pytest.raises(LeaseLost):
        lost.commit()


def test_nats_counts_acknowledgements():
    class Connection:
        def __init__(self, lose):
            self.lose, self.n = lose, 0

        def publish(self, subject, payload, headers):
            f: Future = Future()
            self.n += 1
            f.set_exception(TimeoutError()) if self.n in self.lose else f.set_result(None)
            return f

    NatsSink("n", Connection(()), "x", max_pending=2).write([event(i) for i in range(1, 6)])
    with pytest.raises(RuntimeError, match="1 messages without acknowledgement, first 0/4"):
        NatsSink("n", Connection((4,)), "x", max_pending=10).write([event(i) for i in range(1, 6)])
    a, b = event(1), {**event(1), "after": {"id": "2"}}
    assert message_id(a) == message_id(dict(a)) != message_id(b)


# statements and settings of the sources


def test_pages_by_statement():
    """The page statement walks a table with a key of two columns, quoted names included."""
    db = sqlite3.connect(":memory:")
    db.execute('create table "we""ird" (a int, "k ey" text, v int)')
    db.executemany('insert into "we""ird" values (?, ?, ?)', [(i % 4, f"k{i:02d}", i) for i in range(23)])
    seen, after = [], None
    while True:
        text = postgres.page_statement('.we"ird'.lstrip("."), ["a", "k ey"], 5, after is not None).replace('"public".', "").replace("%s", "?")
        page = db.execute(text, after or ()).fetchall()
        seen += page
        if len(page) < 5:
            break
        after = page[-1][:2]
    assert seen == sorted(seen) and len(seen) == 23


def test_publication_statements():
    assert postgres.publication_statement("p", []) == 'CREATE PUBLICATION "p" FOR ALL TABLES'
    assert postgres.publication_statement('p"q', ["orders", "shop.x"]) == 'CREATE PUBLICATION "p""q" FOR TABLE "public"."orders", "shop"."x"'
    assert postgres.publication_statement("p", ["a"], exists=True) == 'ALTER PUBLICATION "p" ADD TABLE "public"."a"'
    assert postgres.replication_dsn("postgres://h/db") == "postgres://h/db?replication=database" and postgres.replication_dsn("host=h").endswith(" replication=database") and "true" in postgres.mark_statement()


def test_slot_is_dropped_in_time():
    calls, slept = [], []

    def busy():
        calls.append(1)
        if len(calls) < 4:
            raise RuntimeError("in use")
        return True

    postgres.drop_slot(busy, slept.append)
    assert slept == [2, 2, 2]
    with pytest.raises(TimeoutError, match="in use"):
        postgres.drop_slot(lambda: (_ for _ in ()).throw(RuntimeError("in use")), lambda s: None, timeout=6)


def test_unparsed_texts_are_kept(spark):
    d = spark.createDataFrame([({"n": "1", "t": "x"},), ({"n": "one", "t": None},)], "m map<string,string>")
    assert [r[0] for r in d.select(postgres.unparsed(F.col("m"), {"n": "int", "t": "string"})).collect()] == [{}, {"n": "one"}]


def test_recorded_lag(spark, tmp_path):
    """Acknowledged positions give the distance to the log's end, never backwards, and an unknown one before the first."""
    from tideline.config import Postgres
    from tideline.sources import recorded

    row = lambda seq, kind, lsn: (seq, kind, lsn, 1, [1], None, (["t"], [str(seq)]) if kind == "I" else None, T0 if kind == "B" else None)
    spark.createDataFrame([row(1, "B", "0/1"), row(2, "I", "0/10"), row(3, "I", "0/40"), row(4, "C", "0/90")], recorded.PG_MESSAGES).coalesce(1).write.parquet(str(tmp_path / "messages"))
    spark.createDataFrame([(0, 1, "public", "t", ["id"], ["id"])], recorded.PG_RELATIONS).write.parquet(str(tmp_path / "relations"))
    r = build_reader(Source("postgres", "s", postgres=Postgres(recording=str(tmp_path))))
    assert r.lag_bytes(spark) is None or r.lag_bytes(spark) == 0
    r.ack("0/10")
    assert r.lag_bytes(spark) == 0x30
    r.ack("0/8")
    assert r.lag_bytes(spark) == 0x30
    r.ack("0/40")
    assert r.lag_bytes(spark) == 0 and r.tables(spark) == {"public.t": ["id"]}
    records = r.log(spark).orderBy("seq").collect()
    assert [(x.position, x.after, x.commit_ts is not None) for x in records] == [("0/10", {"id": "2"}, True), ("0/40", {"id": "3"}, True)]
    late = r.log(spark, 2).collect()
    assert [(x.seq, x.commit_ts == records[1].commit_ts) for x in late] == [(3, True)]
    bad = spark.createDataFrame([(5, "I", "0/99", 1, [7], None, (["t"], ["x"]), None)], recorded.PG_MESSAGES)
    with pytest.raises(Exception, match="unknown relation 7"):
        r.decode(bad).collect()


def test_mysql_tables():
    known = ["shop.a", "shop.b", "other.c"]
    assert mysql.snapshot_tables(["SHOP.a"], known, "") == ["shop.a"] and mysql.snapshot_tables([], known, "shop") == ["shop.a", "shop.b"]
    for bad, database in ((["a"], "shop"), (["shop.zz"], "shop"), ([], "")):
        with pytest.raises(ValueError):
            mysql.snapshot_tables(bad, known, database)


def test_checkpoint_folder(spark, tmp_path):
    assert cli.checkpoint_folder(spark, "/x") == "/x" and cli.checkpoint_folder(spark, "").endswith("/streams")


def test_command_line_runs_a_pipeline(spark, tmp_path):
    """python -m tideline run, stopped by a signal after the log's end was committed."""
    change_log(spark, SF).coalesce(1).write.parquet(str(tmp_path / "log"))
    (tmp_path / "c.yaml").write_text(f"""
control_plane: {{dsn: {tmp_path}/c.db, auto_migrate: true}}
pipeline:
  id: users
  source: {{type: changelog, changelog: {{path: {tmp_path}/log, snapshot: true, snapshot_mode: chunked, chunk_size: 6}}}}
  sinks: [{{type: stdout}}]
""")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    p = subprocess.Popen([sys.executable, "-m", "tideline", "run", "-config", str(tmp_path / "c.yaml"), "--checkpoint", str(tmp_path / "ck")], cwd=root, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, env=os.environ | {"PYTHONPATH": root})
    lines = []
    reader = threading.Thread(target=lambda: lines.extend(p.stdout))
    reader.start()

    def done():
        if not (tmp_path / "c.db").exists():
            return False
        s = ControlStore(str(tmp_path / "c.db"))
        try:
            s.migrate()
            return (s.snapshot_state("users") or {}).get("phase") == "done" and s.progress("users")[1] == 1000
        finally:
            s.close()

    try:
        assert wait_until(done, 180, 0.5)
    finally:
        p.terminate()
        p.wait(60)
    reader.join(10)
    read = [json.loads(x) for x in lines]
    now = {r.id: r.kind for r in apply.apply_changes(change_log(spark, SF), KEYS["public.users"], COLUMNS).collect()}
    assert {int(e["after"]["id"]): e["after"]["kind"] for e in read if e["op"] == "r"} == now
