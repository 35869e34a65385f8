"""Page extraction, quality, decontamination."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import decontaminate, mainhtml, quality

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cut_cost(scores, edges, keep):
    cost = sum(abs(s) for s, k in zip(scores, keep) if (s > 0) != k and s != 0)
    return cost + sum(w for a, b, w in edges if keep[a] != keep[b])


def test_minimum_cut_is_least():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 8)
        scores = [rng.choice([-3, -2, -1, -0.5, 0.5, 1, 2, 3]) for _ in range(n)]
        edges = [(a, b, rng.choice([0.25, 0.5, 1, 2])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        best = min(cut_cost(scores, edges, k) for k in itertools.product([False, True], repeat=n))
        assert abs(cut_cost(scores, edges, mainhtml.minimum_cut(scores, edges)) - best) < 1e-6
    long = [1.0 if k % 3 else -1.5 for k in range(3000)]
    assert len(mainhtml.minimum_cut(long, [(k, k + 1, 0.7) for k in range(2999)])) == 3000


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site head</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now!</div>
<div id="cookie-notice"><p>We use cookies, a lot of them, on every page of this site.</p></div>
<article><h1>A title &amp; more</h1><p><b>First   paragraph
of&nbsp;the text.<br><p>Second <a href="y">linked</a> one, &eacute;&#233;.</p><aside>Related</aside><p>Third.</p>
<form><p>Sign up here</p></form><div class="comments"><p>I disagree with this article very much.</p></div></article>
<div class="sidebar"><p>Other things that one could read here instead of this.</p></div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert mainhtml.main_text(PAGE) == "A title & more\n\nFirst paragraph of the text.\n\nSecond linked one, éé.\n\nThird."
    assert mainhtml.main_text(None) == mainhtml.main_text("") == mainhtml.main_text("<p> </p>") == ""
    assert mainhtml.main_text("<article><p>One two three.<p>Four five six &am") == "One two three.\n\nFour five six &am"
    plain = "<div><p>A long enough paragraph of plain text, with a sentence.</p><p>Another long enough paragraph of text.</p></div>"
    assert mainhtml.main_text(plain).count("\n\n") == 1
    assert mainhtml.main_text("<article>" + "<div>" * 3000 + "Deep text here." + "</div>" * 3000) == "Deep text here."
    assert mainhtml.main_text("<article><p>x</p><!-- never closed") == "x"


def test_marks_do_not_decide_alone():
    page = """<body><nav><ul><li><a href=x>Home</a></li><li><a href=y>More</a></li></ul></nav><div class="layout has-sidebar"><div id="page-with-comments"><article>
<div class="article-header"><h1>Heading of it</h1></div><p class="side-effects">Side effects are rare but they do happen.</p><section id="legal-history"><p>The law is old.</p></section>
<p>Press <button>Copy</button> to go on, and A&<b>lt</b> is no sign.</p><div class="ad">Buy this thing now, it is cheap.</div></article>
<section class="comments"><p>I do not agree with a word of this.</p></section></div></div><form><p>Your name here, please.</p></form></body>"""
    assert mainhtml.main_text(page).split("\n\n") == ["Heading of it", "Side effects are rare but they do happen.", "The law is old.", "Press to go on, and A&lt is no sign."]
    before = "<body><h1>The title stands outside</h1><p>A short lead.</p><article><p>First of all, this is the text.</p><p>Short.</p></article><footer>&copy; us</footer></body>"
    assert mainhtml.main_text(before).split("\n\n") == ["The title stands outside", "A short lead.", "First of all, this is the text.", "Short."]
    form = "<body><form action=x><div><p>All of this page stands in a form, as some servers write it.</p><p>It is text nevertheless.</p></div></form></body>"
    assert mainhtml.main_text(form).count("\n\n") == 1


def test_main_text_of_written_pages():
    """Pages whose main text is known, with it inside and outside of an article element, of another seed than the classifier's."""
    rng = random.Random(2024)
    exact = extra = missed = total = 0
    for _ in range(250):
        page, kept = mainhtml.sample_page(rng)
        got = mainhtml.main_text(page).split("\n\n")
        exact += got == [x for x in got if x in set(kept)] and set(got) == set(kept)
        extra, missed, total = extra + len(set(got) - set(kept)), missed + len(set(kept) - set(got)), total + len(kept)
    assert exact >= 225 and extra <= 0.015 * total and missed <= 0.01 * total


def test_classifier_weights_are_least_loss():
    """The fitted weights are where the penalised log-loss has no slope."""
    rng, x, y = random.Random(17), [], []
    for _ in range(400):
        page, kept = mainhtml.sample_page(rng)
        blocks = mainhtml.parse(page)
        texts = [b.text for b in blocks]
        x.append(mainhtml.features(blocks, texts))
        y += [t in set(kept) for t in texts]
    x, w = np.concatenate(x), np.array(mainhtml.trained().features)
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - np.array(y)) + 0.1 * w
    assert np.abs(slope).max() < 1e-3


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (None, "u", "", "old")], "page_id long, url string, html string, text string")
    rows = {r.page_id: r.text for r in mainhtml.extract(df).collect()}
    assert rows[1].startswith("A title") and rows[2] == "" and rows[None] == ""
    assert mainhtml.extract(df.where("false")).count() == 0
    long = "<article><p>" + "word " * 200_000 + "</p></article>"
    twice = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, "u", long, 1)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.page_id, len(r.text), r.n_chars) for r in mainhtml.extract(twice).collect()) == sorted([(1, len(rows[1]), 1)] * 2 + [(2, 999_999, 1)])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_quality(spark):
    big = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{n}.parquet") for n in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    held = [(rows[x.doc_id].predicted, x.quality) for x in labels.collect() if rows[x.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good text"), (2, ""), (3, None), (None, "x " * 30000), (1, "good text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 7)], "doc_id long, quality int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert quality.quality_scores(docs.where("false"), labels).count() == 0


def plain_fit(rows, s):
    """The training loop in plain Python: one document, one class and one number at a time."""
    rng = np.random.default_rng(s.seed)
    table = rng.uniform(-1 / s.dim, 1 / s.dim, ((1 << s.bits) + 1, s.dim)).astype(np.float32).astype(float).tolist()
    layer, done = [[0.0] * s.dim, [0.0] * s.dim], 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            ids, share, label = rows[k]
            rate = s.rate * (1 - done / (s.epochs * len(rows)))
            done += 1
            mean = [sum(w * table[i][d] for i, w in zip(ids, share)) for d in range(s.dim)]
            logits = [sum(x * m for x, m in zip(layer[c], mean)) for c in (0, 1)]
            top = [np.exp(x - max(logits)) for x in logits]
            slope = [t / sum(top) - (c == label) for c, t in enumerate(top)]
            back = [sum(slope[c] * layer[c][d] for c in (0, 1)) for d in range(s.dim)]
            for c in (0, 1):
                layer[c] = [x - rate * slope[c] * m for x, m in zip(layer[c], mean)]
            for i, w in zip(ids, share):
                table[i] = [x - rate * w * len(ids) ** 0.5 * b for x, b in zip(table[i], back)]
    return [sum(x * (b - a) for x, a, b in zip(row, *layer)) for row in table]


def test_quality_training_is_plain_gradient_descent():
    import pyarrow as pa

    rng, s = random.Random(6), quality.Settings(bits=7, dim=3, epochs=3)
    texts = [" ".join(rng.choice("ab cd efg hij ## $$".split()) for _ in range(rng.randint(1, 12))) for _ in range(25)]
    rows = [(ids, share, k % 2) for k, (ids, share) in enumerate(quality.sparse(pa.array(texts), s.bits))]
    assert np.allclose(quality.fit(rows, s), plain_fit(rows, s), atol=2e-5)


def test_quality_score_is_the_mean_of_its_features(spark):
    """score() against a sum over the listed features, each text alone, with columns of clashing names."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    model = rng.normal(0, 4, (1 << 9) + 1).astype(np.float32)
    texts = ["", "a", "a a a b a", "é日 x\ny\tz", "the " * 4000, None, "two words", "two words"]
    df = spark.createDataFrame([(k, t, "own", True) for k, t in enumerate(texts)], "doc_id long, text string, score string, held_out boolean").coalesce(1)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    for k, t in enumerate(texts):
        ids, share = next(iter(quality.sparse(pa.array([t or ""]), 9)))
        assert abs(got[k] - 1 / (1 + np.exp(-float((share.astype(float) * model[ids]).sum())))) < 1e-4
        words = (t or "").split()
        assert len(ids) >= min(1, len(words)) + 1 and abs(share.sum() - 1) < 1e-5
    assert quality.score(df, model).columns == ["doc_id", "text", "held_out", "score"]


def brute(texts, items):
    def grams(h, n):
        return {tuple(h[k : k + n]) for k in range(len(h) - n + 1)}

    out = set()
    for d, text in texts:
        h = decontaminate.loose_words(text).tolist()
        for i, item in items:
            sides = [decontaminate.loose_words(x).tolist() for x in decontaminate.split_item(item or "")]
            if not sum(map(len, sides)):
                continue
            shares = []
            for side in sides:
                n = min(5, len(side))
                want = grams(side, n) if n else set()
                shares.append(len(want & grams(h, n)) / len(want) if want else 1.0)
            if min(shares) >= 0.8:
                out.add((d, i))
    return out


def test_decontamination(spark):
    rng = random.Random(9)
    vocab = [f"v{k}" for k in range(900)] + ["the", "of", "a"] * 100
    some = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(k, f"{some(rng.randint(8, 30))}?\n{some(rng.randint(5, 12))}.") for k in range(40)] + [(40, None), (41, ""), (42, some(70)), (43, "one"), (44, items0 := "Stand by. Me")]
    texts = []
    for d in range(300):
        body = some(rng.randint(0, 300))
        if d % 6 == 0:
            body += f" %%{items[rng.randrange(40)][1].upper() if d % 12 else items[42][1]}$$ " + some(rng.randint(0, 200))
        texts.append((d, body))
    texts += [(1000, ""), (1001, items0.lower()), (1002, some(30000))]
    docs = spark.createDataFrame([*texts, (None, items[3][1]), (1003, None)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id is not None} == brute(texts, items)
    assert (None, 3) in {(r.doc_id, r.item_id) for r in found} and len(found) > 45
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize("cells", [1, 4 << 20])
def test_retrieval_is_complete(monkeypatch, cells):
    """Block-max retrieval gives what scoring every item gives, also of many passages at once."""
    monkeypatch.setattr(decontaminate, "MOST_CELLS", cells)
    rng = random.Random(3)
    items = [(k, " ".join(f"t{rng.randrange(60)}" for _ in range(rng.randint(3, 9)))) for k in range(50)]
    index = decontaminate.Index(items)
    for _ in range(30):
        terms = np.unique(np.array(rng.sample(range(len(index.terms)), 20)))
        _, found, scores = index.retrieve(np.zeros(len(terms), np.int64), terms, 0.4)
        full = np.zeros(len(index.ids))
        mine = np.isin(index.term, terms)
        np.add.at(full, index.item[mine].astype(int), index.impact[mine])
        assert set(found.tolist()) == set(np.flatnonzero(full >= 0.4 - 1e-5).tolist())
        assert np.allclose(scores, full[found], atol=1e-5)


    passages = [sorted(rng.sample(range(len(index.terms)), rng.randint(1, 25))) for _ in range(40)]
    flat = [np.repeat(np.arange(40), [len(p) for p in passages]), np.concatenate(passages)]
    at, found, scores = index.retrieve(*flat, 0.4)
    want = {}
    for k, terms in enumerate(passages):
        full = np.zeros(len(index.ids))
        mine = np.isin(index.term, terms)
        np.add.at(full, index.item[mine].astype(int), index.impact[mine])
        want |= {(k, i): full[i] for i in np.flatnonzero(full >= 0.4 - 1e-5).tolist()}
    assert dict(zip(zip(at.tolist(), found.tolist()), np.round(scores, 4).tolist())) == {k: round(v, 4) for k, v in want.items()} and len(want) > 5


def test_decontamination_of_odd_rows(spark):
    """Clashing columns, null and repeated rows, and very long texts, with one pass and with several."""
    item = "Which of the many words here is the one that nobody wrote down?\nThe last of them all."
    docs = spark.createDataFrame([(1, f"x {item} y", "own", 5), (1, f"x {item} y", "own", 5), (None, item, "own", 5), (2, None, "own", 5), (3, "filler " * 50_000 + item, "own", 5), (4, "", "own", 5)], "doc_id long, text string, matches string, item_id int")
    for n in (1, decontaminate.PASS_ITEMS + 1):
        items = spark.createDataFrame([(k, f"unlike all else {k} stands number {k}\nand so does {k}") for k in range(n - 1)] + [(9999, item), (None, item)], "item_id long, text string")
        found = sorted((str(r.doc_id), str(r.item_id)) for r in decontaminate.contaminated(docs, items).collect())
        assert found == sorted([(d, i) for d in ("1", "1", "None", "3") for i in ("9999", "None")])
    assert decontaminate.find_items(docs, items).columns == ["doc_id", "text", "item_id", "matches"]


def test_scores_do_not_depend_on_passes(spark, monkeypatch):
    """The passes' hits and scores are those of one pass over all items."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    some = lambda k: [rng.choice(vocab) for _ in range(k)]
    items = [(k, " ".join(some(60))) for k in range(25)] + [(25, None), (26, "!"), (3, "rare words alone stand here")]
    docs = []
    for d in range(56):
        own = (items[d % 28][1] or "").split()
        docs.append((d, " ".join([*some(30), *own[:10], "changed", *own[11:], *some(d)])))
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r.doc_id, r.item_id, round(r.bm25, 5)) for r in decontaminate.contaminated(docs, bench).collect())
    whole = found()
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 9)
    split = found()
    assert len(whole) > 45 and [x[:2] for x in split] == [x[:2] for x in whole]
    assert [x[2] for x in split] == pytest.approx([x[2] for x in whole], abs=2e-5)
