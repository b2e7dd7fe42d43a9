"""What lets the queries on sinks go through large logs: nothing on the driver grows with the log."""

import threading

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tideline.plans import runtime
from tideline.plans.catalog import QUERIES
from tideline.plans.routing import Counting, routed
from tideline.plans.scratch import Recorder
from tideline.sources.changelog import change_log
from tideline.streaming import delivery
from tideline.streaming.control import ControlStore
from tideline.streaming.delivery import encoded, rows


def parts(df):
    return [r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]


def test_recorder(spark):
    """Parts of bounded size, in the order of the rows; no row is an empty frame."""
    r = Recorder(spark, "recorded", "n long, t string")
    r.ROWS, r.CHARACTERS = 10, 1000
    for i in range(25):
        r.put(i, "x" * 2000 if i == 3 else None)
    d = r.frame()
    assert r.parts == 4 and sorted(parts(d)) == [1, 4, 10, 10]
    assert [(x.n, x.t) for x in d.orderBy("n").collect()] == [(i, "x" * 2000 if i == 3 else None) for i in range(25)]
    empty = Recorder(spark, "recorded", "n long, t string").frame()
    assert empty.count() == 0 and empty.columns == ["n", "t"]


def test_events_are_the_rows_of_the_log(spark, monkeypatch):
    """Events made on the executors have the values that the rows have, in their order."""
    log = change_log(spark, SF).withColumn("commit_ts", F.when(F.col("seq") % 7 != 0, F.col("commit_ts"))).withColumn("more", F.array(F.struct(F.col("seq").alias("n"))))
    want = [r.asDict(recursive=True) for r in encoded(log).orderBy("seq").collect()]
    for e in want:
        e["commit_ts"] = e["commit_ts"] and delivery.EPOCH + delivery.timedelta(microseconds=e["commit_ts"])
    assert list(rows(encoded(log))) == want
    (protobuf,) = {type(e["payload"]) for e in rows(encoded(log.drop("more"), "protobuf"))}
    assert protobuf is bytes


def test_held_hands_over_many_at_a_time():
    """The order stays, the bound holds, and the two threads meet for many events at once."""
    held, got, most, takes = delivery.Held(100), [], 0, 0

    def feed():
        for i in range(20000):
            assert held.put(i, lambda: False)
        held.end()

    t = threading.Thread(target=feed)
    t.start()
    while not (held.ended and not held):
        most = max(most, len(held))
        some = held.take(500, 1)
        takes += 1
        got += some
    t.join()
    assert got == list(range(20000)) and most <= 100 and takes < 10000


@pytest.mark.parametrize("name", ["stdout_sink_lines", "kafka_sink_messages", "nats_sink_messages"])
def test_sent_messages_do_not_gather_on_the_driver(spark, monkeypatch, name):
    monkeypatch.setattr(Recorder, "ROWS", 100)
    d = QUERIES[name](spark, SF)
    n = change_log(spark, SF).count()
    assert max(parts(d)) <= 100 and d.count() == n and d.agg(F.countDistinct("seq"), F.min("seq"), F.max("seq")).first() == (n, 1, n)


def test_parking_costs_the_same_however_much_is_parked():
    """The next number is found by the key, without a look at what is parked; pages lose nothing."""
    store = ControlStore(":memory:")
    store.migrate()
    store.acquire("p", "me", 600)
    steps = []

    def parked(n):
        count = [0]
        store.db.set_progress_handler(lambda: count.__setitem__(0, count[0] + 1), 10)
        store.dead_letter("p", "me", "s", f"0/{n}", 2, "bad", "{}")
        store.db.set_progress_handler(None, 0)
        steps.append(count[0])

    for n in range(2000):
        parked(n)
    assert steps[-1] <= steps[10] + 5
    want = [("s", f"0/{n}", 2, "bad", "{}") for n in range(2000)]
    assert store.dead_letters("p") == want and [list(store.parked("p", k)) == want for k in (1, 1000, 1999, 2000, 5000)] == [True] * 5


def test_a_snapshot_that_dies_in_a_table_of_one_chunk(spark, tmp_path):
    """Truncates leave fewer rows than a chunk holds, as no key comes again: the leader still dies before it is done."""
    import duckdb

    from tests.duck import spark_rows, sql_rows
    from tideline.plans.catalog import ORACLE

    spark.range(2000).selectExpr("id as event_id", "timestamp_ntz '2024-01-01' as ts", "id as user_id", "case when id % 5 = 0 then 'signup' else 'view' end as event_type", "double(id) as value", "'{}' as props").where("event_id < 1000").coalesce(1).write.parquet(str(tmp_path / "e"))
    (part,) = (tmp_path / "e").glob("*.parquet")
    (tmp_path / "events.parquet").write_bytes(part.read_bytes())
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = QUERIES["snapshot_crash_convergence"](spark, str(tmp_path))
    assert spark_rows(got, str(tmp_path / "out"), c) == sql_rows(c, ORACLE["snapshot_crash_convergence"])


def test_router_encodes_once_for_all_sinks(spark, monkeypatch):
    """Sinks of one encoding read the same blocks, and each gets every event in order, through a queue shorter than a block."""
    calls, real = [], delivery.encoded
    monkeypatch.setattr(delivery, "encoded", lambda df, encoding="json": calls.append(encoding) or real(df, encoding))
    monkeypatch.setattr(delivery, "PART", 300)  # several partitions
    sinks = [Counting("a"), Counting("b"), Counting("c", 3)]
    log = change_log(spark, SF)
    routed(spark, log, sinks, batch_max_events=50, queue_size=10)
    n = log.count()
    assert calls == ["json"] and [(s.got, s.late, s.last) for s in sinks] == [(n, 0, n)] * 3


def test_blocks_are_unpacked_once_for_readers_near_each_other(spark, monkeypatch):
    unpacked, real = [], delivery.pickle.loads
    with delivery.kept_blocks(change_log(spark, SF), "json", "json") as made:
        blocks = made["json"]
        found = [(r.size, bytes(r.block)) for r in blocks.df.collect()]
        monkeypatch.setattr(delivery.pickle, "loads", lambda b: unpacked.append(len(b)) or real(b))
        first, second = ([blocks._events(i, b, size) for i, (size, b) in enumerate(found)] for _ in range(2))
        assert first == second and len(unpacked) == len(found) and not blocks.near and not blocks.bytes
        blocks.newest, blocks.NEAR = -1, 0  # nothing waits: who comes later unpacks for itself
        assert [blocks._events(i, b, size) for i, (size, b) in enumerate(found) for _ in range(2)] == [e for e in first for _ in range(2)]
        assert len(unpacked) == 3 * len(found) and not blocks.near


def test_stuck_sink_waits_as_long_as_the_other_goes_on(spark, monkeypatch):
    """Time alone doesn't end the query: it did when the limit was for the whole log."""
    real, calls = runtime.wait_until, []
    monkeypatch.setattr(runtime, "wait_until", lambda done, timeout: bool(calls.append(timeout) or len(calls) > 1 and real(done, timeout)))
    n = change_log(spark, SF).count()
    assert {tuple(r) for r in runtime.stuck_sink(spark, SF).collect()} == {("free", n, n), ("stuck", 0, 0)}
