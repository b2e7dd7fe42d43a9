"""The log is dealt out by its numbers without a pass over whole events; where they lie unevenly, by a sample as before."""

from collections import deque

from pyspark.sql import functions as F

from tideline.sources.changelog import change_log
from tideline.streaming import delivery

from tests.conftest import SF


def numbers(df):
    return [[r.seq for r in part] for part in df.select("seq").rdd.glom().collect()]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_even_numbers_need_no_sample(spark):
    log = change_log(spark, SF)
    n = log.count()
    d = delivery.in_ranges(log, 100)
    got = numbers(d)
    assert [x for part in got for x in part] == sorted(x for part in got for x in part) and sum(map(len, got)) == n
    assert len(got) == -(-n // 100) and max(map(len, got)) <= 200
    assert " ASC" not in plan(d).split("Sort [")[1].split("\n", 1)[1]  # no range below the sort


def test_odd_numbers(spark):
    """Far apart, repeated, missing and at the ends of what a number can be."""
    rows = [*range(500), *[7] * 300, 2**62, -(2**62), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(x,) for x in [*rows, None]], "seq long").repartition(5)
    for most in (50, 100_000):
        got = [x for part in numbers(delivery.in_ranges(df, most)) for x in part]
        assert got == [None, *sorted(rows)]
    none = delivery.in_ranges(df.where("seq is null"), 50)
    assert numbers(none) == [[None]] and numbers(delivery.in_ranges(df.where(F.lit(False)), 50)) in ([], [[]])


def test_held_wakes_its_reader_for_half_the_room():
    held = delivery.Held(100)
    assert not held.put_all(list(range(150)), lambda: True) and len(held) == 100
    held.full = True
    assert held.take(30, 0) == list(range(30)) and held.full
    assert held.take(30, 0) == list(range(30, 60)) and not held.full
    assert held.lists == deque([list(range(100))]) and held.take(500, 0) == list(range(60, 100)) and len(held) == 0
