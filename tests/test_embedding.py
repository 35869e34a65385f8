"""Embedding jobs: superseded ones end at once, and what is stored is what the provider gives."""

import time

import numpy as np

from lodestone.operators import vectors
from lodestone.plans.engine import Engine


def frame(spark, n):
    rows = [(f"src/f{k}.py", f"text of file {k}", "py", True, str(k)) for k in range(n)]
    return spark.createDataFrame(rows, "relative_path string, content string, extension string, is_code boolean, content_hash string")


def test_a_later_job_ends_the_earlier_one(spark, tmp_path):
    class SlowWords(vectors.HashedWords):
        """A provider that takes two seconds a text."""

        def embed(self, texts):
            time.sleep(2 * len(texts))
            return super().embed(texts)

    engine = Engine(spark, str(tmp_path / "wh"))
    engine.refresh(frame(spark, 60))
    engine.provider = SlowWords
    engine.embed(background=True, slices=1)  # 120 seconds of work for one task
    first, thread = engine.progress, engine._job
    end = time.time() + 60
    while not spark.sparkContext.statusTracker().getActiveJobsIds() or not first["total"]:
        assert time.time() < end
        time.sleep(0.1)
    time.sleep(3)
    engine.provider = vectors.HashedWords
    began = time.time()
    engine.embed()
    thread.join(60)
    assert not thread.is_alive() and time.time() - began < 60
    assert first["done"] == 0 and first["error"] is None and not first["active"]
    assert engine.progress["done"] == 60 and engine.progress["error"] is None
    stored = engine.warehouse.read("vectors")
    assert stored.count() == stored.select("relative_path").distinct().count() == 60


def test_vectors_are_those_of_the_provider(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "wh"), None, vectors.HashedWords)
    engine.refresh(frame(spark, 5))
    model = vectors.HashedWords()
    for row in engine.warehouse.read("vectors").collect():
        assert np.allclose(row.embedding, model.embed([row.text])[0]) and np.isclose(np.linalg.norm(row.embedding), 1)
