import io
import json
import sqlite3
import sys
import threading
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tests.conftest import SF
from tideline import cli, config
from tideline.functions import encoding
from tideline.plans.catalog import QUERIES
from tideline.sources.changelog import COLUMNS, KEYS, change_log
from tideline.streaming.control import ControlStore, LeaseLost
from tideline.streaming.delivery import Delivery, Policy, Router
from tideline.streaming.observe import Health, Registry, Server
from tideline.streaming.runner import Runner
from tideline.streaming.sinks import BrokerSink, ProcessSink, StdoutSink, UpsertSink, WebhookSink

MINIMAL = """
control_plane:
  dsn: /tmp/none.db
pipeline:
  id: pg-main
  source:
    type: postgres
  sinks:
    - type: stdout
"""


def event(seq, op="c", id_=None, **kw):
    return {"seq": seq, "source_id": "src", "schema": "public", "table": "t", "op": op, "before": {"id": str(id_ or seq)} if op == "d" else None, "after": {"id": str(id_ or seq), **kw} if op in "cur" else None, "position": f"0/{seq:04X}", "commit_ts": None}


@pytest.fixture
def store(tmp_path):
    s = ControlStore(str(tmp_path / "control.db"))
    s.migrate()
    s.migrate()
    yield s
    s.close()


class Fake:
    def __init__(self, name, bad=(), fail=0):
        self.name, self.bad, self.fail, self.got, self.calls = name, set(bad), fail, [], 0

    def write(self, events):
        self.calls += 1
        if self.fail:
            self.fail -= 1
            raise RuntimeError("busy")
        if any(e["seq"] in self.bad for e in events):
            raise RuntimeError("poison")
        self.got += [e["seq"] for e in events]

    def close(self):
        pass


# configuration


def test_defaults():
    c = config.parse(MINIMAL)
    p = c.pipelines[0]
    assert c.control_plane.lease_ttl == 10 and c.control_plane.lease_renew < 10 and c.instance_id
    assert p.source.id == "pg-main" and p.source.postgres.slot == "tideline_pg_main" and p.source.postgres.chunk_size == 10000
    s = p.sinks[0]
    assert (s.name, s.queue_size, s.batch_max_events, s.batch_max_wait, s.retry_initial, s.retry_max, s.on_failure) == ("stdout", 4096, 500, 0.2, 0.25, 30, "retry")
    assert s.pgupsert.deleted_column == "_deleted_at" and s.nats.max_pending == 256 and s.process.timeout == 60


def test_environment(monkeypatch):
    monkeypatch.setenv("TIDELINE_DSN", "/tmp/secret.db")
    assert config.parse(MINIMAL.replace("/tmp/none.db", "${TIDELINE_DSN}")).control_plane.dsn == "/tmp/secret.db"


@pytest.mark.parametrize(
    "change, message",
    [
        (("dsn: /tmp/none.db", "auto_migrate: true"), "control_plane.dsn is required"),
        (("pipeline:", "x: y\npipeline:"), "field x not found"),
        (("- type: stdout", "- type: stdout\n    - type: stdout"), "duplicate sink name"),
        (("\n    - type: stdout", " []"), "at least one sink"),
        (("- type: stdout", "- type: stdout\n      max_attempts: 3"), "max_attempts with on_failure: retry"),
        (("- type: stdout", "- type: stdout\n      on_failure: dead_letter"), "no max_attempts"),
        (("- type: stdout", "- type: stdout\n      on_failure: explode"), "on_failure 'explode'"),
        (("dsn: /tmp/none.db", "dsn: x\n  lease_ttl: 10 seconds"), "invalid duration"),
        (("dsn: /tmp/none.db", "dsn: x\n  lease_ttl: 5s\n  lease_renew: 5s"), "lease_renew"),
        (("- type: stdout", "- type: stdout\n      encoding: protobuf"), "takes no encoding"),
        (("type: postgres", "type: postgres\n    postgres:\n      snapshot_mode: some"), "snapshot_mode"),
        (("id: pg-main", "id: ''"), "define pipeline"),
        (("control_plane:", "pipelines:\n  - id: other\ncontrol_plane:"), "not both"),
    ],
)
def test_rejected(change, message):
    with pytest.raises(config.ConfigError, match=message):
        config.parse(MINIMAL.replace(*change))


@pytest.mark.parametrize("text, seconds", [("1h30m", 5400), ("200ms", 0.2), ("0", 0), ("1.5s", 1.5), ("2us", 2e-6)])
def test_durations(text, seconds):
    assert abs(config.Duration.parse(text) - seconds) < 1e-9


def test_cli(capsys, tmp_path):
    assert cli.main([]) == 1
    assert cli.main(["version"]) == 0 and cli.main(["schema"]) == 0 and cli.main(["help"]) == 0
    assert "CREATE TABLE" in capsys.readouterr().out
    assert cli.main(["explode"]) == 1
    path = tmp_path / "c.yaml"
    path.write_text(MINIMAL.replace("/tmp/none.db", str(tmp_path / "x.db")))
    assert cli.main(["migrate", "-config", str(path)]) == 0 and (tmp_path / "x.db").exists()
    assert cli.main(["run", "-config", str(path), "-log-level", "loud"]) == 1


# control store


def test_lease(store):
    assert store.acquire("p", "a", 10, now=0) and not store.acquire("p", "b", 10, now=9) and store.acquire("p", "a", 10, now=9)
    assert store.holder("p", now=10) == "a" and store.holder("p", now=20) == ""
    assert store.acquire("p", "b", 10, now=20)
    store.release("p", "a")  # not its own
    assert store.holder("p", now=21) == "b"
    store.release("p", "b")
    assert store.acquire("p", "c", 10, now=22)


def test_sixteen_race(store, tmp_path):
    def one(i):
        s = ControlStore(str(tmp_path / "control.db"))
        try:
            return s.acquire("race", f"i{i}", 60)
        finally:
            s.close()

    with ThreadPoolExecutor(16) as pool:
        assert sum(pool.map(one, range(16))) == 1


def test_fencing(store):
    store.acquire("p", "a", 10, now=0)
    store.save_offset("p", "a", "0/10", now=1)
    store.acquire("p", "b", 10, now=11)
    for write in (
        lambda: store.save_offset("p", "a", "0/05", now=12),
        lambda: store.advance_cursor("p", "a", "s", "0/05", 5, now=12),
        lambda: store.begin_snapshot("p", "a", now=12),
        lambda: store.dead_letter("p", "a", "s", "0/05", 1, "e", "{}", now=12),
    ):
        with pytest.raises(LeaseLost):
            write()
    assert store.load_offset("p") == "0/10" and store.load_offset("other") is None


def test_snapshot_state(store):
    store.acquire("p", "a", 10, now=0)
    store.begin_snapshot("p", "a", "chunked", "slot", "0/1", now=1)
    store.save_chunk("p", "a", "public.t", '["9007199254740993"]', now=1)
    assert store.snapshot_state("p")["chunk_key"] == '["9007199254740993"]'
    store.complete_snapshot("p", "a", now=2)
    assert store.snapshot_state("p")["phase"] == "done" and store.snapshot_state("p")["consistent_lsn"] == "0/1"
    store.begin_snapshot("p", "a", "", "slot", "0/2", now=3)
    s = store.snapshot_state("p")
    assert (s["phase"], s["mode"], s["chunk_table"]) == ("running", "single", None)


# delivery


def deliver(store, sink, events, **policy):
    store.acquire("p", "me", 600)
    d = Delivery("p", "me", sink, store, Policy(**policy), sleep=lambda s: False)
    d.run(events)
    return d


def test_order_and_batches(store):
    sink = Fake("s")
    deliver(store, sink, [event(i) for i in range(1, 26)], batch_max_events=10)
    assert sink.got == list(range(1, 26)) and sink.calls == 3 and store.cursors("p") == [("s", "0/0019", 25)]


def test_retries(store):
    waits, sink = [], Fake("s", fail=4)
    store.acquire("p", "me", 600)
    d = Delivery("p", "me", sink, store, Policy(retry_initial=1, retry_max=3), sleep=lambda s: waits.append(s))
    d.run([event(1)])
    assert waits == [1, 2, 3, 3] and sink.got == [1] and d.metrics.get("tideline_write_failures_total", pipeline="p", sink="s") == 4


def test_only_poison_is_parked(store):
    sink = Fake("s", bad=[3])
    deliver(store, sink, [event(i) for i in range(1, 6)], dead_letter=True, max_attempts=2)
    assert sink.got == [1, 2, 4, 5] and [d[1] for d in store.dead_letters("p")] == ["0/0003"] and store.cursors("p")[0][2] == 5


def test_parking_that_fails_stops_everything(store):
    store.acquire("p", "other", 600)
    d = Delivery("p", "me", Fake("s", bad=[1]), store, Policy(dead_letter=True, max_attempts=1), sleep=lambda s: False)
    with pytest.raises(LeaseLost):
        d.run([event(1)])
    assert store.cursors("p") == []


def test_slowest_sink_decides(store):
    acked = []
    store.acquire("p", "me", 600)
    fast, slow = (Delivery("p", "me", Fake(n), store) for n in ("fast", "slow"))
    r = Router("p", "me", store, [fast, slow], acked.append)
    fast.run([event(i) for i in range(1, 10)])
    assert r.commit() is None and acked == []  # one has nothing yet
    slow.run([event(1), event(2)])
    assert r.commit() == "0/0002" and r.commit() == "0/0002" and acked == ["0/0002"] and store.load_offset("p") == "0/0002"


def test_failover(store):
    led, done = [], threading.Event()

    def work(plan, lost):
        led.append(plan)
        done.wait(5)

    a = Runner("p", "a", store, work, ttl=1, renew=0.1)
    t = threading.Thread(target=a.run)
    t.start()
    b_led = threading.Event()
    b = Runner("p", "b", store, lambda plan, lost: b_led.set(), ttl=1, renew=0.1)
    tb = threading.Thread(target=b.run)
    tb.start()
    assert not b_led.wait(0.5) and len(led) == 1 and led[0].force_bootstrap
    a.stop()
    done.set()
    assert b_led.wait(5)
    b.stop()
    t.join(5), tb.join(5)


# sinks


def test_stdout():
    out = io.StringIO()
    StdoutSink("s", out).write([event(1, note="a<b"), event(2, "d")])
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert lines[0]["after"] == {"id": "1", "note": "a<b"} and "before" not in lines[0] and lines[1]["commit_ts"] == "0001-01-01T00:00:00Z"


def test_webhook():
    seen, status = [], [200]

    class H(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            seen.append((dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(status[0])
            self.end_headers()
            self.wfile.write(b"x" * 1000)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    sink = WebhookSink("w", f"http://127.0.0.1:{server.server_port}/", {"X-Key": "k"})
    sink.write([])
    sink.write([event(1), event(2)])
    headers, body = seen[0]
    assert len(seen) == 1 and headers["Idempotency-Key"] == "src|0/0001|0/0002" and headers["X-Key"] == "k" and body["count"] == 2 and body["last_position"] == "0/0002"
    status[0] = 503
    with pytest.raises(RuntimeError, match="503"):
        sink.write([event(3)])
    server.shutdown()


CHILD = """
import sys, json, time
for line in sys.stdin:
    r = json.loads(line)
    ids = [e["after"]["id"] for e in r["events"]]
    if "13" in ids: print(json.dumps({"ok": False, "error": "unlucky"}), flush=True)
    elif "14" in ids: time.sleep(30)
    elif "15" in ids: sys.exit(3)
    else: print(json.dumps({"ok": True}), flush=True)
"""


def test_process():
    s = ProcessSink("p", [sys.executable, "-c", CHILD], timeout=5)
    s.write([event(1)])
    first = s.child.pid
    with pytest.raises(RuntimeError, match="unlucky"):
        s.write([event(13)])
    s.write([event(2)])
    assert s.child.pid == first
    with pytest.raises(RuntimeError, match="without an answer"):
        s.write([event(15)])
    s.timeout = 0.5
    with pytest.raises(TimeoutError):
        s.write([event(14)])
    s.timeout = 10
    s.write([event(3)])
    s.close()


def test_process_sink_gets_the_whole_log(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    rows = sorted(QUERIES["process_sink_roundtrip"](spark, SF).collect())
    assert [r.batch for r in rows] == list(range(-(-n // 50))) and sum(r.events for r in rows) == n > 200


@pytest.mark.parametrize("soft", [False, True])
def test_upserts(soft):
    db = sqlite3.connect(":memory:")
    db.execute('create table t (id text primary key, name text, bio text, "_deleted_at" text)')
    s = UpsertSink("u", db, {"t": ["id"]}, schema="", soft_delete=soft)
    s.write([event(1, id_=1, name="a", bio="long"), event(2, "u", 1, name="b"), event(3, id_=2, name="x")])
    s.write([event(2, "u", 1, name="b"), event(4, "d", 2), event(4, "d", 9)])
    rows = db.execute('select id, name, bio, "_deleted_at" is null from t order by id').fetchall()
    assert rows == [("1", "b", "long", 1)] + [("2", "x", None, 0)] * soft
    with pytest.raises(Exception, match="ghost"):
        s.write([event(5, id_=7, name="n"), event(6, id_=8, ghost="n")])
    assert db.execute("select count(*) from t where id = '7'").fetchone() == (0,)
    s.write([event(7, "t")])
    assert db.execute('select count(*) from t where "_deleted_at" is null').fetchone() == (0,)


def test_broker():
    class Client:
        def __init__(self):
            self.sent, self.flushed = [], 0

        def publish(self, **m):
            self.sent.append(m)

        def flush(self):
            self.flushed += 1

    c = Client()
    BrokerSink("b", c, lambda e: "topic", lambda e: "k", encoding="protobuf").write([event(1), event(2)])
    m = encoding.message_class().FromString(c.sent[1]["value"])
    assert c.flushed == 1 and c.sent[0]["headers"]["idempotency-key"] == "src|public.t|0/0001" and m.after["id"] == "2"
    with pytest.raises(ValueError, match="avro"):
        BrokerSink("b", c, lambda e: "t", encoding="avro")


# encodings


def test_protobuf_round_trip():
    e = {**event(1, "u"), "before": {"n": 1.5, "s": "x", "z": None, "raw": b"\x00", "at": datetime(2024, 1, 1)}, "commit_ts": datetime(2024, 1, 2)}
    m = encoding.message_class().FromString(encoding.encode_message(e))
    assert m.before["n"] == 1.5 and m.before["z"] is None and m.before["at"] == "2024-01-01 00:00:00" and m.commit_ts.seconds == 1704153600
    assert not encoding.message_class().FromString(encoding.encode_message(event(1))).HasField("commit_ts")


def test_unknown_encoding():
    with pytest.raises(ValueError, match="avro"):
        encoding.encoder("avro")
    assert encoding.encoder("")[1] == "application/json"


# observability


def test_pages():
    r, h = Registry(), Health()
    r.add("tideline_events_read_total", 3, pipeline='a"b')
    r.set("own_gauge", 7)
    h.set("p", leader=True, streaming=True)
    s = Server("127.0.0.1:0", r, h)
    s.start()
    get = lambda p: urllib.request.urlopen(f"http://{s.address}{p}").read().decode()
    assert 'tideline_events_read_total{pipeline="a\\"b"} 3\n' in get("/metrics") and "own_gauge 7" in get("/metrics") and "tideline_leader" not in get("/metrics")
    assert get("/healthz") == "ok\n" and "pipeline: p role: leader streaming: true" in get("/readyz")
    with pytest.raises(OSError):
        Server(s.address, r, h)
    s.stop()


# streams


def test_stream_to_sinks_and_restart(spark, store, tmp_path):
    """Killed after some batches and started again from the committed position, sinks get everything, in order."""
    from tideline.streaming.replay import replay_stream

    path, log = str(tmp_path / "log"), change_log(spark, SF)
    for k in range(4):
        log.where(f"seq > {k * 250} and seq <= {(k + 1) * 250}").coalesce(1).write.mode("append").parquet(path)
    total = 1000
    store.acquire("p", "me", 600)
    sinks = [Fake("one"), Fake("two")]

    def router():
        return Router("p", "me", store, [Delivery("p", "me", s, store, Policy(batch_max_events=100)) for s in sinks])

    class Killed(Exception):
        pass

    first, seen = router(), []

    def dies(df, i):
        if i == 2:
            raise Killed
        first.foreach_batch(df, i)
        seen.append(i)

    q = replay_stream(spark, path, 0, 1).writeStream.foreachBatch(dies).option("checkpointLocation", str(tmp_path / "c1")).start()
    with pytest.raises(Exception):
        q.awaitTermination(120)
    at = int(store.load_offset("p").split("/")[1], 16)
    assert 0 < at < total
    second = router()
    q = replay_stream(spark, path, at, 2).writeStream.foreachBatch(second.foreach_batch).option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        from tideline.streaming.delivery import wait_until

        assert wait_until(lambda: store.load_offset("p") == f"0/{total:04X}", 90)
    finally:
        q.stop()
    assert all(s.got == list(range(1, total + 1)) for s in sinks)


def test_stream_into_mirror(spark, tmp_path):
    from tideline.plans.catalog import QUERIES
    from tideline.streaming.mirror import Mirror
    from tideline.streaming.replay import replay_stream

    log = change_log(spark, SF)
    for k in range(3):
        log.where(f"seq > {k * 350} and seq <= {(k + 1) * 350}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    m = Mirror(spark, str(tmp_path / "mirror"), KEYS["public.users"], COLUMNS)
    q = replay_stream(spark, str(tmp_path / "log"), 0, 1).writeStream.foreachBatch(m.apply).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, m.current().collect())) == sorted(tuple(r[c] for c in [*COLUMNS, "last_seq"]) for r in QUERIES["materialize_state"](spark, SF).collect())
