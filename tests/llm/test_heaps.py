"""A stage of the pipeline starts with heaps that hold no garbage of the one before: a grown heap counts to the executor's memory for all stages that follow."""

import corpus_pipeline

from tests.conftest import SF


def test_each_stage_collects_first(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for module, name in ((corpus_pipeline.langid, "identify"), (corpus_pipeline.lines, "remove_boilerplate"), (corpus_pipeline.similar, "near_copies"), (corpus_pipeline.decontaminate, "decontaminate"), (corpus_pipeline.packing, "pack")):
        monkeypatch.setattr(module, name, lambda *a: (_ for _ in ()).throw(StopIteration("begun")))
    monkeypatch.setattr(corpus_pipeline, "train_language_model", lambda docs: None)
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        try:
            stage(spark, docs, SF)
        except StopIteration:
            pass
        assert full() > before, name
