"""Periodic runs against a plain search, and the query against a plain version of its contract."""

import hashlib
import random
import re
import zlib

from lodestone.llm import periodic
from lodestone.llm.queries import op12_periodic_runs


def plain_runs(words, min_exp=4, min_length=6):
    """Every stretch that no neighbouring word extends, with its smallest period."""
    n, found = len(words), set()
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(min_length, min_exp * q) and all(any(stretch[k] != stretch[k + p] for k in range(len(stretch) - p)) for p in range(1, q)):
                found.add((i, j + q - i, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def texts_of(seed):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "x a b a b a b a y", " ".join("a" * 400), "é é é é é é é é", "\x0b\x0ca\rb"]
    for _ in range(120):
        words = [rng.choice("abcd") for _ in range(rng.randrange(1, 80))]
        for _ in range(rng.randrange(3)):
            block = [rng.choice(("a", "b", "long-word", "ß")) for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (block * rng.randrange(2, 9))[: rng.randrange(1, 60)]
        texts.append(rng.choice((" ", "\n", " \t ")).join(words))
    return texts + texts[:20]


def test_runs_equal_the_plain_search(spark):
    texts = texts_of(1)
    rows = [(k % 90 if k % 17 else None, t, "x") for k, t in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    want = []
    for k, t, _ in rows:
        words = split(t)
        runs = plain_runs(words)
        want.append((k, len(words), tuple(runs), plain_collapse(words, runs)))
    for cost in (periodic.RANGE_COST, 50):  # whole texts together, and lag ranges of one text
        got = [(r.id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periodic.find_runs(documents, range_cost=cost).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_other_exponents(spark):
    texts = texts_of(2)
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: [tuple(x) for x in r.runs] for r in periodic.find_runs(documents, min_exp=2, min_length=3, range_cost=100).collect()}
    assert got == {k: plain_runs(split(t), 2, 3) for k, t in enumerate(texts)}


def test_very_long_text_is_shared_by_ranges(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(30000)]
    words[7000:25000] = (words[7000:11000] * 5)[:18000]
    documents = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    (row,) = periodic.find_runs(documents, range_cost=1 << 22).collect()
    assert [tuple(r) for r in row.runs] == [(7000, 18000, 4000)] or [r.period for r in row.runs] == [4000]
    assert row.collapsed == plain_collapse(words, [tuple(r) for r in row.runs])


def test_empty_table(spark):
    documents = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.find_runs(documents).collect() == []


def test_query_equals_its_contract(spark, tmp_path):
    texts = texts_of(4)
    rows = [(k * 37 - 500 if k % 11 else None, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, planted = [], 0
    for i, t in rows:
        words = split(t)
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(plain_collapse(words, runs))))
    got = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert planted > 3
    assert sorted(got, key=str) == sorted(want, key=str)
