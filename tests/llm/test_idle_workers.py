"""A Python worker keeps nothing of a task that is through: idle ones count to the executor's memory for all stages that follow."""

import gc
import weakref

import pandas as pd

from tideline.llm import common, packing


def test_memory_goes_back_after_each_task(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    done = common.lean(lambda batches: (b for b in batches))(iter([1, 2, 3]))
    assert next(done) == 1 and not given
    assert list(done) == [2, 3] and len(given) == 1
    left = common.lean(lambda batches: (b for b in batches))(iter([1, 2]))
    next(left)
    left.close()  # a task that ends early
    assert len(given) == 2


def test_batches_of_texts_are_bounded_by_bytes(spark):
    """The plan of a stage runs after the stage returned it: the bound holds then. One that is lower stays."""
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def lengths(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    try:
        corpus_pipeline.pack(spark, spark.range(3).selectExpr("id as doc_id", "'a b' as text"), "")
        texts = spark.range(0, 9000, 1, 1).selectExpr("repeat('x', 2000) as text")
        assert max(r.n for r in texts.mapInPandas(lengths, "n long").collect()) < 2500
        spark.conf.set(key, "1m")
        common.text_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_the_tokenizer_goes_with_its_task(spark, monkeypatch):
    made, run, real = [], [], packing.Tokens

    class Tokens(real):
        def __init__(self, path):
            super().__init__(path)
            made.append(weakref.ref(self))

    class Docs:
        def select(self, *columns):
            return self

        def mapInPandas(self, f, schema):
            run.append(f)

    monkeypatch.setattr(packing, "Tokens", Tokens)
    packing.pieces(Docs())
    rows = pd.concat(run[0](iter([pd.DataFrame({"doc_id": [1], "text": ["a cat and a hat"]})])))
    gc.collect()
    assert len(rows) == 1 and rows["length"][0] > 5 and [r() for r in made] == [None]
