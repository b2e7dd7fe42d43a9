"""Events travel as columns: a value is made where a sink looks at it, and reads as it did."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tideline.functions.encoding import _quoted, image_json
from tideline.plans.routing import Counting
from tideline.sources.changelog import change_log
from tideline.streaming import delivery


def test_only_what_a_sink_looks_at_is_made(spark):
    with delivery.kept_blocks(change_log(spark, SF), "json") as made:
        sink, events = Counting("s"), next(iter(made["json"]))
        sink.write(events)
        columns = events[0]._columns
        assert sink.got == len(events) == columns.batch.num_rows and set(columns) == {"seq"}
        one = dict(events[0])
        assert events[0] == one and list(one) == columns.names and len(events[0]) == len(one) and events[0].get("none") is None and "none" not in events[0]
        assert json.loads(one["payload"])["position"] == one["position"]
        with pytest.raises(KeyError):
            events[0]["none"]


def test_texts_are_quoted_as_to_json_does(spark):
    texts = ["", "a", " ~!#[]", 'a"b', "a\\b", "a\nb", "a\n", "\t", "\x7f", "\x00", "é", "😀", " ", "a/b", "<&>", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    one = F.to_json(F.array("t"))
    assert d.where(~_quoted(F.col("t")).eqNullSafe(F.substring(one, F.lit(2), F.length(one) - 2))).collect() == []
    m = F.create_map(F.lit("b"), "t", F.lit('a"'), F.lit("1"), F.lit("c"), F.lit("2"))
    got = [r[0] for r in d.select(image_json(m, iter(["c"]))).collect()]
    assert [(list(json.loads(g).items()), g.endswith(',"c":2}')) for g in got] == [([('a"', "1"), ("b", t), ("c", 2)], True) for t in texts]
