"""Line removal where the documents lie, and by a join: the same rows, and no text is shuffled in the first."""

from tideline.llm import lines

ROWS = [(i, f"s{i % 7}", "\n".join(["all have this", f"only {i}", "", "some have it" if i % 7 < 5 else "", "all have this"])) for i in range(20)]
ROWS += [(None, "s1", "all have this\nx"), (None, "s2", "first without id"), (30, "s3", None), (31, None, ""), (5, "s5", ROWS[5][2])]


def test_in_place_as_by_the_join(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    got = lines.remove_boilerplate(docs, 6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    key = lambda r: tuple(map(str, r))
    here = sorted(map(tuple, got.collect()), key=key)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    assert here == sorted(map(tuple, lines.remove_boilerplate(docs, 6).collect()), key=key)
    cut = {r[0]: r for r in here}
    assert cut[0][4] == 0 and cut[1][2:] == ("only 1\n\nsome have it", 5, 2) and cut[30][2:] == (None, 0, 0) and cut[31][2:] == ("", 1, 0)
