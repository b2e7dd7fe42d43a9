"""The set-based fold against a sequential interpreter of the same rules."""

import itertools
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tideline.model import SCHEMA
from tideline.operators.apply import apply_changes, violations
from tideline.streaming.mirror import Mirror

COLUMNS = {"id": "bigint", "a": "string", "b": "string"}
T0 = datetime(2024, 1, 1)


def event(seq, op, id_=None, before=None, **cols):
    after = None if op in "dt" else {"id": str(id_), **cols}
    before = {"id": str(id_ if before is None else before)} if op == "d" or before is not None else None
    return (seq, "src", "public", "t", op, before, after, f"0/{seq:04X}", T0 + timedelta(seconds=seq))


def sequential(events, soft=False, rekey=False):
    rows = {}
    for seq, _, _, _, op, before, after, _, ts in sorted(events, key=lambda e: e[0]):
        if op == "t":
            if soft:
                for r in rows.values():
                    r["del"] = r["del"] or ts
            else:
                rows.clear()
        elif op == "d":
            if not soft:
                rows.pop(before["id"], None)
            elif before["id"] in rows:
                rows[before["id"]]["del"] = ts
        else:
            if rekey and op == "u" and before and before["id"] != after["id"]:
                rows.pop(before["id"], None)
            r = rows.setdefault(after["id"], {"a": None, "b": None, "del": None})
            r.update({k: v for k, v in after.items() if k != "id"})
            r["del"], r["seq"] = None, seq
    return {(int(k), r["a"], r["b"], r["seq"], *([r["del"]] if soft else [])) for k, r in rows.items()}


value = st.sampled_from([None, "x", "y"])
cols = st.fixed_dictionaries({}, optional={"a": value, "b": value})
change = st.tuples(st.sampled_from("cuuurddt"), st.integers(0, 3), cols, st.none() | st.integers(0, 3))


def build(changes, moves=False):
    return [event(i + 1, op, k, before=m if moves and op == "u" else None, **c) if op != "t" else event(i + 1, "t") for i, (op, k, c, m) in enumerate(changes)]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.lists(change, min_size=1, max_size=14), min_size=6, max_size=6), st.booleans(), st.booleans())
def test_fold_matches_interpreter(spark, logs, soft, moves):
    for changes in logs[:2]:
        events = build(changes, moves and not soft)
        log = spark.createDataFrame(events + events[::2], SCHEMA)  # repeats don't matter
        got = apply_changes(log, ["id"], COLUMNS, soft_delete=soft, rekey=moves and not soft)
        rows = {(r.id, r.a, r.b, r.last_seq, *([r._deleted_at] if soft else [])) for r in got.collect()}
        assert rows == sequential(events, soft, moves and not soft)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(change, min_size=4, max_size=16), st.integers(1, 15))
def test_mirror_folds_batches(spark, tmp_path_factory, changes, cut):
    events = build(changes)
    m = Mirror(spark, str(tmp_path_factory.mktemp("mirror")), ["id"], COLUMNS)
    for i, part in enumerate([events[:cut], events[cut:]]):
        df = spark.createDataFrame(part, SCHEMA)
        m.apply(df, i)
        m.apply(df, i)  # the same batch again changes nothing
    assert {(r.id, r.a, r.b, r.last_seq) for r in m.current().collect()} == sequential(events)


@pytest.mark.parametrize(
    "e, keys, reason",
    [
        ((1, "s", "public", "t", "u", None, {"a": "1"}, "p", None), {"t": ["id"]}, "u on public.t is missing key column id"),
        ((1, "s", "public", "t", "c", None, {}, "p", None), {"t": ["id"]}, "c event on public.t has no after image"),
        ((1, "s", "public", "t", "d", None, None, "p", None), {"public.t": ["id"]}, "delete on public.t has no before image"),
        ((1, "s", "public", "t", "d", {"a": "1"}, None, "p", None), {"t": ["id"]}, "delete on public.t is missing key column id"),
        ((1, "s", "", "t", "c", None, {"id": "1"}, "p", None), {"x": ["id"]}, "no key columns for t"),
        ((1, "s", "public", "t", "t", None, None, "p", None), {"x": ["id"]}, None),
        ((1, "s", "public", "t", "?", None, None, "p", None), {"t": ["id"]}, "unknown op ?"),
        ((1, "s", "public", "t", "c", None, {"id": "1"}, "p", None), {"t": ["id"]}, None),
    ],
)
def test_violations(spark, e, keys, reason):
    assert spark.createDataFrame([e], SCHEMA).select(violations(keys)).first()[0] == reason


def test_chunk_rows_of_partial_images_stay(spark):
    """A window event that leaves a column out must not lose the column of the snapshot row."""
    from pyspark.sql import functions as F

    from tideline.operators import snapshot

    log = spark.createDataFrame([event(1, "c", 1, a="old", b="keep"), event(12, "u", 1, a="new")], SCHEMA)
    plan = spark.createDataFrame([(0, 1, 10, 11, 15)], "chunk long, id long, lw long, read_seq long, hw long")
    pages = snapshot.read_chunks(log, plan, ["id"], COLUMNS, apply_changes)
    for parity, b in ((False, "keep"), (True, None)):
        placed = snapshot.place_rows(log, plan, pages, "id", "bigint", parity)
        rows = placed.select(F.col("at").alias("seq"), F.lit("s").alias("source_id"), F.lit("public").alias("schema"), F.lit("t").alias("table"), F.lit("r").alias("op"), F.lit(None).cast("map<string,string>").alias("before"), F.map_from_arrays(F.array(*map(F.lit, COLUMNS)), F.array(*[F.col(c).cast("string") for c in COLUMNS])).alias("after"), F.lit("").alias("position"), F.lit(None).cast("timestamp").alias("commit_ts"))
        got = apply_changes(rows.unionByName(log.where("seq > 5")), ["id"], COLUMNS).first()
        assert (got.a, got.b) == ("new", b)


def test_keyset_walk(spark):
    from tideline.operators.snapshot import keyset_page

    pairs = list(itertools.product(range(3), "abc"))
    df = spark.createDataFrame(pairs, "k1 int, k2 string")
    seen, last = [], None
    while page := [tuple(r) for r in keyset_page(df, ["k1", "k2"], last, 4).collect()]:
        seen, last = seen + page, page[-1]
    assert seen == pairs
