"""Batched vector search against plain cosines, and words of several tokens in the engine."""

import numpy as np
import pytest

from lodestone.operators import search, vectors
from lodestone.plans.engine import Engine


def plain(stored, asked, k):
    out = {}
    for q, v in asked:
        if v is None or not any(v):
            continue
        found = []
        for key, w in stored:
            if w is not None and len(w) == len(v):
                scale = np.linalg.norm(v) * np.linalg.norm(w)
                found.append((-round(float(np.dot(v, w) / scale) if scale else 0.0, 6), key))
        if found:
            out[q] = [(r + 1, key, -s) for r, (s, key) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize(("stored_rows", "query_rows"), [(1 << 14, 1 << 10), (7, 3)])
def test_batched_top_k(spark, stored_rows, query_rows):
    rng = np.random.default_rng(1)
    stored = [(k, rng.integers(-2, 3, 4).astype(float).tolist()) for k in range(60)]  # many ties and some zero vectors
    stored += [(100, [1.0, 2.0]), (101, [2.0, 1.0]), (102, None), (103, [])]
    asked = [(f"q{k}", rng.integers(-2, 3, 4).astype(float).tolist()) for k in range(12)] + [("zero", [0.0] * 4), ("two", [1.0, 1.0]), ("none", None), ("three", [1.0] * 3)]
    a = spark.createDataFrame(stored, "vec_id long, embedding array<double>")
    b = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    got = {}
    for r in sorted(vectors.batch_top_k(a, b, 5, digits=6, stored_rows=stored_rows, query_rows=query_rows).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = plain(stored, asked, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]] and np.allclose([x[2] for x in got[q]], [x[2] for x in want[q]], atol=2e-6)
    assert vectors.batch_top_k(a.limit(0), b, 5).collect() == [] == vectors.batch_top_k(a, b.limit(0), 5).collect()


def test_a_word_of_several_tokens_is_one_term(spark, tmp_path):
    project = {"docs/a.md": "call open.file now and open.file later", "docs/b.md": "file then open", "docs/c.md": "open the file", "docs/d.md": "x open.file.open.file.open y"}
    rows = [(p, c, "md", False, str(hash(c))) for p, c in project.items()]
    engine = Engine(spark, str(tmp_path / "wh"))
    engine.refresh(spark.createDataFrame(rows, "relative_path string, content string, extension string, is_code boolean, content_hash string"))
    paths = lambda q: {r.relative_path for r in engine.bm25(q, None, 9).collect()}
    assert paths("open.file") == {"docs/a.md", "docs/d.md"} and paths("open file") == set(project)
    assert paths("open.file.open") == {"docs/d.md"}
    post, stats = engine.warehouse.read("postings"), engine.warehouse.read("field_stats")
    got = {r.relative_path: r.matches for r in search.phrase_matches(post, "content", ["open", "file", "open"]).collect()}
    assert got == {"docs/d.md": 2}
    n, mean, length = 4, (8 + 3 + 3 + 7) / 4, 7
    want = np.log(1 + (n - 1 + 0.5) / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * length / mean))
    assert np.isclose(search.phrase_scores(post, stats, "content", ["open", "file", "open"], 2.0).first().score, 2 * want)


def test_cosine_to_a_known_query(spark):
    from lodestone.functions import analyze
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), ([3.0, 4.0],)], "v array<float>")
    got = [r.x for r in df.select(analyze.cosine_to(F.col("v"), [1.0, 1.0]).alias("x")).collect()]
    assert np.isclose(got[0], 0.5**0.5) and got[1] == 0.0 and got[2] is None and np.isclose(got[3], 7 / 5 / 2**0.5)
    assert vectors.cosine_scores(df, [0.0, 0.0], "v").count() == 0 and vectors.cosine_scores(df, [1.0], "v").count() == 1
