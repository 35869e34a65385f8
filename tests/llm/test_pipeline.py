"""The pipeline: each stage against a plain version of it on its own input, and the registered queries."""

import hashlib
import os
import random
import re

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import bpe, decontaminate, lines, queries
from lodestone.llm.components import UnionFind

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean prose, junk, copies, near copies, shared lines and benchmark items, with nulls and repeated rows."""
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in ("ser", "mon", "tal", "rin", "ost", "vel") for b in ("a", "en", "ium", "or", "as", "ing", "uth")]
    prose = lambda k: "\n".join(" ".join(rng.choice(vocab) for _ in range(11)).capitalize() + "." for _ in range(max(1, k // 11)))
    junk = lambda k: " | ".join(rng.choice(vocab) + rng.choice(["###", "$$$", "%%%"]) for _ in range(k))
    items = [(k, prose(33)) for k in range(5)]
    rows, labels = [], []
    near = " ".join(rng.choice(vocab) for _ in range(120))
    for d in range(240):
        bad = d % 6 == 5
        text = junk(60) if bad else prose(rng.randint(20, 160))
        if d % 20 == 2:
            text += "\n" + items[rng.randrange(5)][1]
        if d % 17 == 3 and not bad:
            words = near.split()
            words[rng.randrange(120)] = "changed"
            text = " ".join(words)
        rows.append((d, text, "en", "s", len(text)))
        labels.append((d, 0 if bad else 1, 0))
    rows += [(300, rows[0][1], "en", "s", 0), (301, rows[4][1], None, None, None), (302, None, "en", "s", 0), (303, "", "en", "s", 0)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(items)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark, tables, tmp_path):
    folder, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        seen[name] = (before, after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    before, after = seen["quality_filter"]
    assert all((d in after) == (d % 6 != 5) for d in before if d < 240)
    before, after = seen["line_dedup"]
    earlier = {}
    for d in sorted(before):
        for x in {x for x in (before[d].text or "").split("\n") if x.strip()}:
            earlier.setdefault(x, d)
    for d, row in before.items():
        kept = (after[d].text or "").split("\n") if d in after else []
        assert [x for x in (row.text or "").split("\n") if x in set(kept)] == kept or not row.text
        assert all(earlier[x] == d or len(x) < lines.MIN_BLOCK_CHARS for x in kept if x.strip())
    assert 300 not in after and 302 in after and 303 in after
    assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
    before, after = seen["near_duplicates"]
    sets = UnionFind()
    own = {d: shingles(r.text) for d, r in before.items()}
    for a in own:
        for b in own:
            if a < b and own[a] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                sets.union(a, b)
    assert set(after) == {d for d in before if sets.find(d) == d} and len(after) < len(before)
    before, after = seen["decontamination"]
    for d, row in before.items():
        words = " ".join(decontaminate.loose_words(row.text).astype(str))
        assert (d in after) != any(" ".join(decontaminate.loose_words(t).astype(str)) in words for t in items.values())
    before, after = seen["bpe_tokens"]
    library = Tokenizer.from_file(bpe.default_path())
    for d, row in before.items():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert (after[d].n_tokens, after[d].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    final = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()}
    assert final == {d: r.ids_sha256 for d, r in after.items()}


def test_extra_columns(spark, tables, tmp_path):
    """Columns whose names the stages use themselves come through unchanged."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    extra = ("score", "items", "matches", "component_id", "class_id", "gone", "n_lines", "mark", "row", "key", "order", "label", "quality")
    wide = docs.withColumns({c: F.lit(f"own {c}") for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, more = stage(spark, docs, tables[0]), stage(spark, wide, tables[0])
        assert more.columns == wide.columns, name
        plain.write.parquet(str(tmp_path / name))
        more.write.parquet(str(tmp_path / f"{name}-wide"))
        docs, wide = spark.read.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / f"{name}-wide"))
        assert sorted(map(repr, wide.select(docs.columns).collect())) == sorted(map(repr, docs.collect()))
        assert all(wide.where(F.col(c).isNull() | (F.col(c) != f"own {c}")).isEmpty() for c in extra)


def test_empty_input(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables[0]).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_every_row(spark, name):
    if name == "op13_hash_forest":  # 20 rows for each row that asks
        rows = queries.QUERIES[name](spark, SF).groupBy("query_id").count().collect()
        asking = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()
        assert sorted(map(tuple, rows)) == sorted((r[0], 20) for r in asking)
        return
    table, key = ("pages", "page_id") if name == "op5_html_extraction" else ("documents", "doc_id")
    got = [r[0] for r in queries.QUERIES[name](spark, SF).select(key).collect()]
    want = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
    assert sorted(got) == sorted(want) if name != "op10_decontamination" else set(got) <= set(want)
