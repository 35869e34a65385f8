"""Near duplicates, substring and line dedup against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import jaccard, lines, substring
from lodestone.llm.components import UnionFind, connected_components
from lodestone.llm.fmindex import FMIndex, WaveletMatrix
from lodestone.runtime import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=260):
    """Random texts, a hot line, a hot passage, exact copies, chains of near copies, and odd rows."""
    rng = random.Random(seed)
    vocab = ["w%d" % k for k in range(400)] + ["É", "é", "Ab", "aB"]
    some = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, line, base = some(60), some(8), some(150)
    texts = []
    for k in range(n):
        words = some(rng.randint(1, 120))
        if k % 3 == 0:
            words = words[:10] + line + words[10:]
        if k % 5 == 0:
            words = words + passage + some(20)
        if k % 7 == 0:
            words = [w.upper() if rng.random() < 0.2 else w for w in base]
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words).replace("w1 ", "w1\n").replace("w2 ", "w2\t \r"))
    texts += [texts[0]] * 40 + [texts[7]] * 5 + ["", "one", "One", "two words", "a b c d", "a b c d e", "\x0b\x0c", "word " * 4000, "word " * 4001, "x" * 50000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * k, texts[j]) for k, j in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*corpus(), (None, "one"), (None, None), (5000, None)]
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, rep string, n int").repartition(7).persist()


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(fold(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_LIST", 8)  # so that long lists and blocks are met
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect() if r.doc_id is not None]
    sets = UnionFind()
    for k, (a, s) in enumerate(rows):
        for b, t in rows[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                sets.union(a, b)
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert {d: (got[d].n_shingles, got[d].component_id) for d, _ in rows} == {d: (len(s), sets.find(d)) for d, s in rows}
    assert len({sets.find(d) for d, _ in rows}) < len(rows) - 60
    assert jaccard.near_duplicates(docs).count() == docs.count()
    assert got[None].component_id is None
    assert jaccard.near_duplicates(docs.where("false")).count() == 0


def test_block_links_connects_all():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 100 - k], rng.integers(0, 1 << 60, k).astype(np.uint64)])) for k in range(0, 40, 4)]
    want = UnionFind()
    for i, a in enumerate(sets):
        for j in range(i):
            if jaccard.linked(len(a), len(sets[j]), len(np.intersect1d(a, sets[j]))):
                want.union(i, j)
    n, alone = np.array([len(x) for x in sets]), np.arange(len(sets))
    for k in (1, 3, 8):  # whatever each asks for, no link is lost
        wanted = np.minimum(np.arange(len(sets)) % k + 1, [jaccard.required(m) for m in n])
        prefixes = [x[: m - jaccard.required(m) + w] for x, m, w in zip(sets, n.tolist(), wanted.tolist())]
        keep = jaccard.candidates_of(n, wanted, alone, prefixes)
        assert all(keep[i] for i in range(len(sets)) if any(want.find(i) == want.find(j) for j in range(len(sets)) if j != i))
    other = np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64) * np.uint64(2))
    assert not jaccard.candidates_of(np.array([100, 100]), np.array([1, 1]), np.arange(2), [other[:21], sets[0][:21]]).any()
    apart = ~np.eye(len(sets), dtype=bool)
    assert np.array_equal(jaccard.overlaps(sets)[apart], np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])[apart])
    got = UnionFind()
    for a, b in jaccard.block_links(list(range(len(sets))), list(range(len(sets))), sets):
        got.union(a, b)
    assert [got.find(k) for k in range(len(sets))] == [want.find(k) for k in range(len(sets))]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1120)] + [(2000, k) for k in range(2001, 2200)] + [(7, None), (9, 9)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    got = {r.node: r.component for r in connected_components(df, Scratch(spark, "test")).collect()}
    sets = UnionFind()
    for a, b in pairs:
        if b is not None and a != b:
            sets.union(a, b)
    assert got == {n: sets.find(n) for n in sets.parent}


def test_wavelet_and_index():
    rng = np.random.default_rng(2)
    s = np.append(rng.integers(1, 6, 500), 0)  # the last symbol is the separator
    wavelet = WaveletMatrix(s, 7)
    at, c = rng.integers(0, 502, 300), rng.integers(0, 7, 300)
    assert wavelet.rank(c, at).tolist() == [int((s[:p] == x).sum()) for p, x in zip(at, c)]
    index = FMIndex(s, 7, 6)
    ends = np.arange(6, 501)
    far, lo, hi = index.matches(s, ends, 6)
    for e, f, a, b in zip(ends, far, lo, hi):
        count = lambda k: sum(np.array_equal(s[i : i + k], s[e - k : e]) for i in range(len(s) - k + 1))
        assert count(f) == b - a >= 2 and (f == 6 or count(f + 1) < 2)


@pytest.mark.parametrize("hot", [2, 256])
def test_substring(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_PIECES", hot)
    rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None or r.text), key=lambda r: r[0])
    seen, want = set(), {}
    for d, text in rows:
        w = WORD.findall(text)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        want[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    got = {-1 if r.doc_id is None else r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs.where("doc_id is not null or text is not null")).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 2000
    assert substring.remove_repeats(docs.where("false")).count() == 0


def test_substring_tells_null_ids_apart(spark):
    """Rows without an id whose texts have one 32-bit hash keep their own words."""
    from pyspark.sql import functions as F

    text = lambda k: " ".join(f"w{k}x{j}" for j in range(25))
    df = spark.createDataFrame([(None, text(386)), (None, text(186693)), (5, text(386))], "doc_id long, text string")
    assert df.select(F.hash("text").alias("h")).distinct().count() == 1
    got = {(r.doc_id, r.kept): r.n_removed for r in substring.remove_repeats(df).collect()}
    assert got == {(None, text(386)): 0, (None, text(186693)): 0, (5, ""): 25}
    same = spark.createDataFrame([(7, text(386)), (7, text(386)), (7, text(1) + " " + text(386)), (8, None), (9, "")], "doc_id long, text string").withColumns({"spans": F.lit(1), "mark_a": F.lit("x"), "id": F.lit(2)})
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(same).collect()) == [(7, 25, 0), (7, 25, 0), (7, 50, 25), (8, 0, 0), (9, 0, 0)]


def test_patience_aligns():
    """Pairs are equal and rise; no gap begins or ends alike, or holds an item that is unique on both sides."""
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 14))]
        got = [(-1, -1), *lines.patience(a, b), (len(a), len(b))]
        assert all(a[i] == b[j] for i, j in got[1:-1])
        for (i, j), (x, y) in zip(got, got[1:]):
            assert i < x and j < y
            left, right = a[i + 1 : x], b[j + 1 : y]
            if left and right:
                assert left[0] != right[0] and left[-1] != right[-1]
                once = [c for c, k in Counter(left).items() if k == 1]
                assert not any(Counter(right)[c] == 1 for c in once)
    same = list("abcabcd")
    assert lines.patience(same, same) == [(k, k) for k in range(7)]


def brute_lines(rows, least):
    real = {d: [x.strip(" \t\r") for x in t.split("\n") if x.strip(" \t\r")] for d, t in rows}
    holders = defaultdict(list)
    for d in sorted(real):
        for x in set(real[d]):
            holders[x].append(d)
    out = {}
    for d, text in rows:
        partners = {}
        for x in real[d]:
            e, many = holders[x][0], len(holders[x])
            if many > 1 and e < d:
                partners[e] = min(partners.get(e, many), many)
        alive = list(range(len(real[d])))
        for e, _ in sorted(partners.items(), key=lambda p: (p[1], p[0])):
            pairs = lines.patience([real[d][k] for k in alive], real[e])
            gone = {alive[k] for block in lines.common_blocks(pairs) if sum(len(real[d][alive[j]]) for j in block) >= least for k in block}
            alive = [k for k in alive if k not in gone]
        k, kept = -1, []
        for x in text.split("\n"):
            k += bool(x.strip(" \t\r"))
            if not x.strip(" \t\r") or k in alive:
                kept.append(x)
        out[d] = ("\n".join(kept) if alive or not real[d] else "", len(real[d]), len(real[d]) - len(alive))
    return out


def test_line_dedup(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(30)) for _ in range(rng.randint(1, 9))) for _ in range(90)]
    rows = []
    for d in range(140):
        body = [rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(0, 12))]
        if d % 4 == 0:
            k = rng.randrange(60)
            body = body[:2] + pool[k : k + 12] + [""] + body[2:]
        rows.append((d, "\n".join(body)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, ""), (203, " \n\n "), (204, "y" * 90000)]
    df = spark.createDataFrame([(d, t, 5, "m") for d, t in rows], "doc_id long, text string, n_lines int, mark string").repartition(5)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(df).collect()}
    assert got == brute_lines(rows, lines.MIN_BLOCK_CHARS) and sum(g[2] for g in got.values()) > 150
    assert lines.dedup_lines(df).columns == ["doc_id", "text", "mark", "n_lines", "n_removed"]
    nulls = spark.createDataFrame([(None, "same line here, long enough to count\nx"), (1, "same line here, long enough to count\ny"), (1, "same line here, long enough to count\ny"), (2, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text, r.n_removed) for r in lines.dedup_lines(nulls).collect()) == [("1", "y", 1), ("1", "y", 1), ("2", None, 0), ("None", "same line here, long enough to count\nx", 0)]
    assert lines.dedup_lines(df.where("false")).count() == 0


def test_line_dedup_finds_copies_whose_lines_stand_apart_earlier(spark):
    """Each line of a copied pair first stands in a document of its own, and is short."""
    x, y = "one line of twenty one", "other line of nineteen"
    rows = [(1, f"{x}\np"), (2, f"{y}\nq"), (3, f"{x}\n{y}"), (4, f"{x}\n{y}")]
    df = spark.createDataFrame([(d, t, 7, "m", b"g") for d, t in rows], "doc_id long, text string, turn int, mark string, gone binary")
    got = {r.doc_id: (r.text, r.n_removed, r.turn, r.mark, bytes(r.gone)) for r in lines.dedup_lines(df, every_holder=True).collect()}
    assert got == {**{d: (t, 0, 7, "m", b"g") for d, t in rows[:3]}, 4: ("", 2, 7, "m", b"g")}


def test_line_dedup_meets_every_holder(spark):
    """Nothing is left that any earlier document takes, and only lines that stand earlier go."""
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randrange(40)) for _ in range(rng.randint(1, 9))) for _ in range(70)]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for d in range(160)]
    x, y, z = "a long line that stands in many documents", "another long line, held in the other order", "a third line of thirty and more characters"
    short = ["s1 short line", "s2 short line", "s3 short line"]
    rows += [(1000, f"{x}\nown 1"), (1001, f"{x}\nown 2\n{x}"), (1002, f"{x}\nown 3\n{x}\nown 4")]  # more often than the earliest has it
    rows += [(1010, f"{y}\nown 6\n{z}"), (1011, f"own 7\n{z}\nown 8\n{y}\nown 9")]  # crossed
    rows += [(1020 + k, f"{line}\nown {k + 20}") for k, line in enumerate(short)]  # each line has another earliest holder
    rows += [(1030, "\n".join(["own 30", *short])), (1031, "\n".join(["own 31", *short, "own 32"]))]
    rows += [(1040 + k, f"own {k + 40}\n{x}\nown {k + 60}") for k in range(15)]  # a hot line
    df = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string").repartition(5)
    one = {r.doc_id: r.n_removed for r in lines.dedup_lines(df).collect()}
    kept = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(df, every_holder=True).collect()}
    assert kept[1011][0] == "own 7\nown 8\nown 9" and kept[1031][0] == "own 31\nown 32" and kept[1030][1] == 0
    assert kept[1002][0] == "own 3\nown 4" and one[1002] < kept[1002][1] and one[1011] == 1 and one[1031] == 0
    assert all(kept[1040 + k][1] == 1 for k in range(15)) and sum(k[1] for k in kept.values()) > sum(one.values()) + 10
    real = {d: [v for v in t.split("\n") if v] for d, t in rows}
    for d, own in real.items():
        left = [v for v in kept[d][0].split("\n") if v]
        assert len(own) - len(left) == kept[d][1]
        earlier = set().union(*(real[e] for e in real if e < d))
        assert all(v in earlier for v in (Counter(own) - Counter(left)))
        for e in real:
            if e < d:
                alive = list(range(len(left)))
                assert lines.delete_common(left, list(map(len, left)), alive, real[e], lines.MIN_BLOCK_CHARS) == alive, (d, e)


def longest_common_run(a, b):
    """Characters of the longest run of lines that is unbroken in both, by the plain table."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0, *(row[j] + len(x) if x == b[j] else 0 for j in range(len(b)))]
        best = max(best, *row)
    return best


def test_line_dedup_of_a_hot_line_costs_a_row_a_document(spark, tmp_path):
    """Documents with own lines around one repeated line: the line goes, and no table grows with the pairs."""
    from lodestone.runtime import Scratch

    hot = "one line of forty-nine characters, in all of them"
    n = 300
    rows = [(d, f"a{d}\n{hot}\nb{d}\nc{d}\n{hot}\nd{d}") for d in range(n)]
    scratch = Scratch(spark, "hot-line")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in lines.dedup_lines(df, scratch, every_holder=True).collect()}
    assert got == {0: rows[0][1], **{d: f"a{d}\nb{d}\nc{d}\nd{d}" for d in range(1, n)}}
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(scratch.path)
    for status in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder):
        assert spark.read.parquet(status.getPath().toString()).count() <= 7 * n, status.getPath().getName()


def test_line_dedup_leaves_no_common_run(spark):
    """Against all earlier documents by a plain table of common runs; lines from a small pool repeat and cross."""
    rng = random.Random(21)
    pool = [f"{'xyz'[k % 3] * rng.randint(3, 20)} {k}" for k in range(14)]
    rows = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own {d} {k}" for k in range(rng.randint(0, 16)))) for d in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kept = {r.doc_id: r.text.split("\n") if r.text else [] for r in lines.dedup_lines(df, every_holder=True).collect()}
    real = {d: t.split("\n") if t else [] for d, t in rows}
    removed = 0
    for d, own in real.items():
        gone = Counter(own) - Counter(kept[d])
        removed += sum(gone.values())
        assert all(any(x in real[e] for e in range(d)) for x in gone)
        assert all(longest_common_run(kept[d], real[e]) < lines.MIN_BLOCK_CHARS for e in range(d))
        at = iter(own)
        assert all(x in at for x in kept[d])  # in the old order
    assert removed > 100 and kept[0] == real[0]


def test_patience_numbers_lines_that_repeat():
    assert lines.patience("aXbcXd", "pXqrXs") == [(1, 1), (4, 4)]
    assert lines.patience("XXX", "aXbX") == [(0, 1), (2, 3)] or len(lines.patience("XXX", "aXbX")) == 2
