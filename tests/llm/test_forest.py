"""The hash-prefix forest against brute force: exact where it meets everything, recall where it does not."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import forest
from lodestone.llm.queries import op13_hash_forest


def brute(rows, k, asks):
    """{query: [(vec_id, score)]}: ids with several vectors count by their nearest."""
    sound = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    own = {}
    for i, v in sound:
        own.setdefault(i, set()).add(v)
    out = {}
    for q in own:
        if asks(q):
            best = {}
            for i, v in sound:
                if i != q:
                    s = [float((np.array(v) * np.array(w)).sum()) for w in own[q] if len(w) == len(v)]
                    if s:
                        best[i] = max(best.get(i, -np.inf), *s)
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def same(got, want):
    want = {q: x for q, x in want.items() if x}
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12, atol=1e-12)


def odd_rows(seed):
    rng = np.random.default_rng(seed)
    x = np.float32(rng.standard_normal((150, 6)) * rng.choice([0.1, 1, 5], (150, 1)))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    hot = rows[3][1]
    rows += [(1000 + k, hot) for k in range(70)]  # copies of one vector
    rows += rows[:9] + [(5, rows[40][1]), (10, rows[41][1])]  # repeated rows, ids with two vectors
    rows += [(200, None), (205, []), (210, [0.0] * 6), (215, [1.0, None] + [0.0] * 4), (220, [float("nan")] + [1.0] * 5), (225, [float("inf")] + [1.0] * 5), (None, hot)]
    rows += [(300 + k, rng.standard_normal(2).astype(np.float32).tolist()) for k in range(12)]  # another length
    return rows


@pytest.mark.parametrize(("entry_rows", "query_rows"), [(1 << 15, 1 << 13), (40, 7)])
def test_all_candidates_give_the_exact_result(spark, entry_rows, query_rows):
    rows = odd_rows(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, tree string")
    got = forest.nearest(df, F.col("vec_id") % 5 == 0, k=7, trees=3, wish=1 << 40, entry_rows=entry_rows, query_rows=query_rows)
    same(result(got), brute(rows, 7, lambda q: q % 5 == 0))


def test_few_candidates_still_fill_the_list(spark):
    """A small wish stops early, in cut shards too; scores are exact and all different from the query."""
    rows = odd_rows(2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = brute(rows, 1 << 20, lambda q: q % 5 == 0)
    got = result(forest.nearest(df, F.col("vec_id") % 5 == 0, k=7, trees=6, wish=60, entry_rows=30, query_rows=5))
    hits = total = 0
    for q, found in got.items():
        scores = dict(exact[q])
        assert q not in [i for i, _ in found] and len({i for i, _ in found}) == len(found)
        assert all(np.isclose(s, scores[i], rtol=1e-12) for i, s in found)
        hits += len({i for i, _ in found} & {i for i, _ in exact[q][:7]})
        total += min(7, len(exact[q]))
    assert hits / total > 0.6


def test_fewer_rows_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert result(forest.nearest(df, F.col("vec_id") == 0)) == {0: [(1, 0.5), (2, 0.5)]}
    assert forest.nearest(df.limit(0), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, scale):
    table = pq.read_table(f"/root/testdata/{scale}/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist())
    got = result(op13_hash_forest(spark, f"/root/testdata/{scale}"))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        scores[q] = -np.inf
        found = got[int(ids[q])]
        assert len(found) == 20 and all(np.isclose(s, x[np.flatnonzero(ids == i)[0]] @ x[q], rtol=1e-12) for i, s in found)
        hits += len({i for i, _ in found} & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
    assert hits / (20 * len(got)) >= 0.9
