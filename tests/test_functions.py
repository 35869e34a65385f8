"""Scalar functions against definitions worked out by hand or in plain Python."""

import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import analyze, rowlocal


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_content_tokens_fold_and_drop_long_runs(spark):
    assert one(spark, "Straße ÉTÉ x_1 " + "a" * 39 + " " + "a" * 40, analyze.content_tokens) == ["strasse", "ete", "x", "1", "a" * 39]
    assert one(spark, None, analyze.content_tokens) is None


def test_identifier_splits(spark):
    assert one(spark, "loadFileNow", analyze.identifier_parts) == ["load", "File", "Now"]
    assert one(spark, "MAX_RETRY_COUNT", analyze.identifier_parts) == ["MAX", "RETRY", "COUNT"]
    assert one(spark, "toUTF8String", analyze.identifier_parts) == ["to", "UTF", "8", "String"]
    assert one(spark, "XMLParser", analyze.identifier_tokens) == ["xmlparser"]


def test_symbols(spark):
    text = "pub fn start() {}\nstruct Pool<T>;\n  def go(self)\nconst fn zed\nlet mut y\nfn a()\nimpl <A<B>> Thing"
    assert one(spark, text, analyze.symbols) == "Pool Thing fn go mut start"
    assert one(spark, "", analyze.symbols) == ""
    assert one(spark, "impl<T: Into<Vec<Option<Box<Rc<u8>>>>>> Deep<T>\nfn <A<B> open", analyze.symbols) == ""  # no starter; unbalanced
    assert one(spark, "impl <T: Into<Vec<Option<Box<Rc<u8>>>>>> Deep<T>\nclass <x>", analyze.symbols) == "Deep"


def test_snippet_starts_at_definition_and_stops_at_fifteen_lines(spark):
    lines = ["fn outer() {"] + [f"  line {k}" for k in range(8)] + ["  needle here"] + [f"  tail {k}" for k in range(20)]
    got = one(spark, "\n".join(lines), lambda c: analyze.snippet(c, "needle")).split("\n")
    assert got == lines[:15]
    plain = [f"line {k}" for k in range(30)] + ["needle"]
    assert one(spark, "\n".join(plain), lambda c: analyze.snippet(c, "needle")).split("\n") == plain[25:]
    assert one(spark, "", lambda c: analyze.snippet(c, "needle")) == ""


def test_intent_in_both_forms(spark):
    for q in ("src/a.rs", "a::b", "std.io", "end.", "snake_case", "Camel", "two Words", "plain", ""):
        assert one(spark, q, analyze.intent) == analyze.intent_of(q)


def test_paths(spark):
    assert one(spark, "a/./b//../c", analyze.normalize_path) == "a/c"
    assert one(spark, "../../x", analyze.normalize_path) == "x"
    assert one(spark, "a/b.tar.gz", analyze.file_stem) == "b.tar"
    assert one(spark, ".env", analyze.file_stem) == ".env"
    assert one(spark, "Src/Search/index.rs", lambda c: analyze.filename_boost(c, ["nope", "search", "index"])) == 1.3
    assert one(spark, "src/search/index.rs", lambda c: analyze.filename_boost(c, ["ind"])) == 2.0


def test_cosine_edges(spark):
    row = spark.range(1).select(
        analyze.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("a"),
        analyze.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("zero"),
        analyze.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("size"),
    ).first()
    assert abs(row.a - 0.5**0.5) < 1e-9 and row.zero == 0.0 and row["size"] is None


def test_byte_ranges(spark):
    at = lambda off, n: one(spark, "aé\nb" + "c" * 600, lambda c: analyze.byte_range(c, F.lit(off), F.lit(n)))
    assert at(1, 2) == "é" and at(3, 2) == "\nb" and at(603, 50) == "cc" and len(at(9999, 5)) == 500


def test_rust_blanking():
    source = 'let a = "use crate::x;\\" y"; // use crate::z\nlet r = r#"use "q";"#; /* use\n b */ use crate::real;'
    out = rowlocal.blank_rust(source)
    assert len(out) == len(source) and out.count("\n") == source.count("\n")
    assert "use crate::real" in out and out.count("use") == 1


def test_fnv():
    assert rowlocal.fnv1a(b"") == 14695981039346656037
    assert rowlocal.fnv1a(b"a") == 0xAF63DC4C8601EC8C


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab é\n", max_size=3000), max_size=6))
def test_chunk_spans_cover_in_order(parts):
    text = "\n\n".join(parts)
    spans = rowlocal.chunk_spans(text)
    assert all(a < b for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    kept = "".join(text[a:b] for a, b in spans)
    assert "".join(kept.split()) == "".join(text.split()) or len(text.encode()) // 4 <= rowlocal.MAX_TOKENS


def test_chunks_are_bytes_of_the_source(spark):
    text = "\n\n".join("é" * n for n in (10, 2500, 900, 900, 3000)) + "\n" + "\n".join("z" * 900 for _ in range(8))
    for c in one(spark, text, rowlocal.chunks):
        assert text.encode()[c["off"] : c["off"] + c["len"]].decode() == c["text"]
    assert one(spark, "", rowlocal.chunks) == []


def test_fnv_of_many_texts_together():
    rng = random.Random(4)
    texts = [bytes(rng.randrange(256) for _ in range(rng.choice((0, 1, 5, 80, 300)))) for _ in range(200)] + [b"x" * 5000]
    assert rowlocal.fnv1a_of(texts) == [rowlocal.fnv1a(t) for t in texts]
    assert rowlocal.fnv1a_of(texts[:3]) == [rowlocal.fnv1a(t) for t in texts[:3]] and rowlocal.fnv1a_of([]) == []
    got = rowlocal._fnv_batch(pd.Series(["a", None, "", "é"] * 20, index=range(5, 85)))
    assert list(got.index) == list(range(5, 85)) and got.isna().sum() == 20
    assert list(got.dropna()[:3]) == ["af63dc4c8601ec8c", "cbf29ce484222325", f"{rowlocal.fnv1a('é'.encode()):016x}"]
