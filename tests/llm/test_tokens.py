"""BPE and unigram counts against the public library."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from lodestone.llm import bpe, unigram

ODD = [
    "", " ", "  a  b  ", "aaaa aaaaa aaaaaaa", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "it's we'll x \x1c\x1d z\x85q ​　日本語 😀👍🏽 123½ ١٢",
    "\n\n\n a\n b", "\tx\t\ty  ", "''s'S 'LL", "éé ǅ ª º ⁵", "<unk>€ <unk> <unk><unk> <s> <0x0A>\n", "▁a ▁▁b▁", "a▁b c", "word " * 3000, "\x00\x01", "a \n b", "x\n ", "x \ny",
]


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def unigram_library():
    pieces, unknown = unigram.load_pieces(unigram.default_path())
    library = Tokenizer(models.Unigram(pieces, unknown, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    return library


def ids_of(encoder, texts):
    rows, _ = encoder.encode(texts)
    return [[i for u in row for i in encoder.known[u]] for row in rows]


def test_bpe_odd_texts(byte_bpe):
    encoder = bpe.Encoder(bpe.default_path())
    got = ids_of(encoder, ODD)
    assert got == [byte_bpe.encode(t, add_special_tokens=False).ids for t in ODD]
    assert [bpe.decode_ids(encoder.vocab, i) for i in got] == ODD


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_bpe_any_text(byte_bpe, texts):
    encoder = bpe.Encoder(bpe.default_path())
    assert ids_of(encoder, texts) == [byte_bpe.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_queries(spark, byte_bpe):
    texts = [None, *ODD]
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    rows = {r.doc_id: r for r in bpe.round_trip_digest(df).collect()}
    for k, t in enumerate(texts):
        ids = byte_bpe.encode(t or "", add_special_tokens=False).ids
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r for r in bpe.decode(bpe.encode(df)).collect()}
    assert all(back[k].decoded == (t or "") for k, t in enumerate(texts))
    assert bpe.round_trip_digest(df.where("false")).count() == 0
    twice = spark.createDataFrame([(7, "it's", 1), (7, "it's", 1), (7, "other", 1), (None, "y" * 300_000, 1)], "doc_id long, text string, n_tokens int")
    want = sorted((str(d), len(byte_bpe.encode(t, add_special_tokens=False).ids)) for d, t in ((7, "it's"), (7, "it's"), (7, "other"), (None, "y" * 300_000)))
    assert sorted((str(r.doc_id), r.n_tokens) for r in bpe.round_trip_digest(twice).collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab theing▁ é\n€日<unk>"), max_size=40), max_size=8))
def test_unigram_counts(unigram_library, texts):
    counter = unigram.counter(unigram.default_path())
    assert counter.texts(texts) == [len(unigram_library.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.text(st.sampled_from("ab theing▁ é\n€日<unk>語"), max_size=200))
def test_unigram_long_words(unigram_library, text):
    """A word worked off alone has the tokens it has among others."""
    counter, word = unigram.counter(unigram.default_path()), ("▁" + text.replace(" ", "").replace("▁", "")).encode()
    assert counter.long_word(word) == counter.together([word, b"x"])[0]


def test_unigram_long_texts(unigram_library):
    counter = unigram.counter(unigram.default_path())
    texts = ["日本語の文章" * 900, "the" * 2000 + " of" + "\u20ac<unk>" * 700, "x" * 3000]
    assert counter.texts(texts) == [len(unigram_library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_unigram_query(spark, unigram_library):
    df = spark.createDataFrame([(k, t, -1) for k, t in enumerate([None, *ODD])], "doc_id long, text string, n_tokens int")
    got_of = lambda t: len(unigram_library.encode(t, add_special_tokens=False).ids)
    got = {r.doc_id: r.n_tokens for r in unigram.count_tokens(df).collect()}
    assert got == {k: len(unigram_library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate([None, *ODD])}
    assert unigram.count_tokens(df.where("false")).count() == 0
    twice = spark.createDataFrame([(5, "the word"), (5, "the word"), (None, "x" * 100_000)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in unigram.count_tokens(twice).collect()) == sorted([("5", got_of("the word"))] * 2 + [("None", got_of("x" * 100_000))])
