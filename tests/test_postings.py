"""Postings of a whole table, and chunks and cosines in bounded memory."""

from pyspark.sql import functions as F

from lodestone.functions import analyze, rowlocal
from lodestone.operators import search
from lodestone.plans.engine import Engine


def files(spark):
    rows = [
        ("a/x_Y1.rs", "fn deep<T>(x)\r\nÀÉ ß strasse İstanbul ΑΣ Œuvre the the " + "é" * 20 + " " + "é" * 19), ("a/e.rs", ""), ("n.md", None),
        ("s.py", "def a1():\n\tclass Zed:\n x def no\n\ndef a1"), *((f"m/{k}.txt", f"the w{k % 7} and " * (k % 5)) for k in range(50)),
    ]
    return spark.createDataFrame(rows, "relative_path string, content string").selectExpr("relative_path", "content", "'rs' extension", "true is_code", "md5(content) content_hash")


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.select("field", "token", "relative_path", "tf", "positions").collect())


def test_whole_postings_are_the_same_rows_without_a_shuffle(spark, tmp_path, monkeypatch):
    """a commit's postings meet in their documents' rows; a shuffle of each word made a build twice as long."""
    docs = search.search_documents(files(spark))
    monkeypatch.setattr(rowlocal, "TOKENS_TOGETHER", 20)
    whole = search.whole_postings(docs)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    assert rows_of(whole) == rows_of(search.postings(docs))
    monkeypatch.undo()
    engine = Engine(spark, str(tmp_path / "wh"))
    engine.refresh(files(spark))
    assert rows_of(engine.warehouse.read("postings")) == rows_of(search.postings(docs))


def test_plain_tokens_and_texts_without_definitions_take_the_short_way(spark):
    """The short ways give what the long ones give, also beside line ends that are not line feeds."""
    texts = ["Plain ASCII Words", "Grün ÆON mixed İx", "fn one\rdef two\n def three", "a\r\n  \n\tclass Four", "def", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(analyze.content_tokens(F.col("t")), analyze.symbols(F.col("t"))).collect()
    assert [r[0] for r in got[:2]] == [["plain", "ascii", "words"], ["grun", "aeon", "mixed", "i̇x"]]
    assert [r[1] for r in got] == ["", "", "one three", "Four", "", "", None]


def test_only_long_texts_pass_through_python(spark, monkeypatch):
    """whole batches of texts and of their chunks stood in a worker; now long texts do, one at a time, and no chunk's text."""
    texts = ["short", "ü" * 2050, "x" * 4099, "x" * 4100, "äb \n" * 2000, " a\n\nb" * 900 + "\n\n" + "c" * 5000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r for r in df.select("k", rowlocal.chunk_bytes(F.col("t")).alias("b"), rowlocal.chunks(F.col("t")).alias("c")).collect()}
    for k, text in enumerate(texts):
        want = [text[lo:hi] for lo, hi in rowlocal.chunk_spans(text or "")]
        assert [c.text for c in got[k].c] == want and [tuple(b) for b in got[k].b] == [(c.off, c.len) for c in got[k].c]
        assert [(text or "").encode()[b.off : b.off + b.len].decode() for b in got[k].b] == want
    seen = []
    cut = rowlocal.chunk_spans
    monkeypatch.setattr(rowlocal, "chunk_spans", lambda t: seen.append(t) or cut(t))
    import pyarrow as pa

    assert rowlocal._span_batch(pa.array(texts)).to_pylist()[0] == [{"off": 0, "len": 5}] and len(seen) == len(texts)
    plan = df.select(rowlocal.chunk_bytes(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "text" not in plan


def test_scores_of_a_cell_stand_in_memory_in_parts(monkeypatch):
    """a cell's scores, their scale and their rounding were three matrices of 134 MB; products are of a part of the queries."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lodestone.operators import vectors

    rng = np.random.default_rng(3)
    table = lambda name, n: pa.table({name: np.arange(n), "vector": list(rng.integers(-9, 9, (n, 8)).astype(np.float32))})
    stored, asked = table("key", 4000), table("query", 600)
    tracemalloc.start()
    monkeypatch.setattr(vectors, "CELL_SCORES", 1 << 30)
    whole = vectors._best_of_cell(stored, asked, 10, 6)
    at_once = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    monkeypatch.setattr(vectors, "CELL_SCORES", 1 << 16)
    parts = vectors._best_of_cell(stored, asked, 10, 6)
    assert parts.equals(whole) and tracemalloc.get_traced_memory()[1] < at_once / 4
    tracemalloc.stop()


def test_documents_are_analysed_once_for_each_table(spark, monkeypatch):
    """the scores read stored postings and lengths, and documents are analysed twice, not four times."""
    from lodestone import queries

    made = []
    table = queries.Scratch.table
    monkeypatch.setattr(queries.Scratch, "table", lambda self, df, name: made.append(name) or table(self, df, name))
    plan = queries.bm25_postings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert made == ["postings", "stats"] and "regexp_extract_all" not in plan
