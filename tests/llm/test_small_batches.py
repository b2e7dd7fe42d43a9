"""Whole texts reach Python a thousand rows at a time where near copies are looked for, and the session's setting stands afterwards."""

import pandas as pd

from tideline.llm import common, similar

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_texts_come_in_small_batches(spark, monkeypatch):
    before, seen, real = spark.conf.get(KEY), [], common.saved
    monkeypatch.setattr(similar, "saved", lambda df, name: seen.append((name, int(spark.conf.get(KEY)))) or real(df, name))
    docs = spark.range(30).selectExpr("id as doc_id", "concat('one two three four five six ', id % 10) as text")
    assert similar.near_copies(docs).select("component").distinct().count() == 10
    assert [n for name, n in seen if name in ("near-docs", "near-sets")] == [1000] * 3 and spark.conf.get(KEY) == before

    def lengths(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    with common.small_batches(spark, 100):
        assert max(r.n for r in spark.range(0, 1000, 1, 1).mapInPandas(lengths, "n long").collect()) == 100
