"""Benchmark items in many passes: one index at a time, and the same hits as in one pass."""

import random

from lodestone.llm import decontaminate


def test_fifty_passes_do_not_chain(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(30)) + "? " + " ".join(word() for _ in range(10))) for k in range(50)]
    texts = [" ".join(word() for _ in range(40)) + " " + items[k % 50][1] if k % 3 == 0 else " ".join(word() for _ in range(60)) for k in range(60)]
    documents = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*texts, None, ""])], "doc_id long, text string, lang string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    hits = lambda df: {r.doc_id: sorted((m.item_id, round(m.bm25, 6)) for m in r.matches) for r in df.collect()}
    once = hits(decontaminate.find_items(documents, benchmark))
    assert {k for k, m in once.items() if m} == set(range(0, 60, 3))
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 1)
    found = decontaminate.find_items(documents, benchmark)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 1
    assert hits(found) == once and found.columns == [*documents.columns, "matches"]
