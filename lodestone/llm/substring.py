"""Exact substring dedup by compressed FM-indexes over shards.

A window of 20 consecutive words is a repeat if the same words also start earlier (in a document of
smaller id, or earlier in the same one); every word covered by a repeat is removed.

Equal windows must meet in one shard.  The anchor of a window is the least hash of its 8-word runs; a
window has 12 more words, so it holds the 6 words before its anchor or the 6 after it.  The anchor and that
side make the window's key, which equal windows share.  Consecutive windows of one anchor and side form
one piece.  A key that occurs once cannot hold a repeat, and its piece stops there.  Pieces are
merged by key and a hash of their words, keeping their earliest place; only that place's words travel, to the
shard of their key.  Where a key has very many different pieces, their windows are merged and dealt one by
one by their own words, so that no shard grows with a hot passage.
Each shard builds an FM-index of its pieces and streams the same pieces through it: backward search
gives each window's matching statistics, and those that reach 20 words report their interval, whose
earliest place decides.  Within shards words are compared
as text; two pieces merge by 128 bits of hashes.

A null id counts as smaller than any other; rows that repeat an id are told apart by their text, and
equal rows are equal places, none earlier than the other.  Null and empty texts have no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.fmindex import FMIndex
from lodestone.functions.memory import lean
from lodestone.llm.words import blocks, mix, ngrams, stretches_hash
from lodestone.runtime import Scratch

WINDOW, ANCHOR_WORDS, SIDE_WORDS = 20, 8, 6
HOT_PIECES, SHARD_WORDS, LEAST_SHARDS = 256, 250_000, 48
NO_ID = -(1 << 63)
_U = np.uint64


def anchors_of(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts side by side: (text, first window, windows, key, hash of the words)."""
    span = WINDOW - ANCHOR_WORDS + 1
    empty = np.zeros(0, np.int64)
    none = empty, empty, empty, empty.astype(_U), empty.astype(_U)
    counts = np.maximum(np.diff(bounds) - WINDOW + 1, 0)
    if not counts.any():
        return none
    g, side = mix(ngrams(hashes, ANCHOR_WORDS)), ngrams(hashes, SIDE_WORDS)
    at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(len(g) - span + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    window = np.repeat(bounds[:-1], counts) + inner
    anchor = at[window]
    before = anchor - window >= SIDE_WORDS
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (before[1:] != before[:-1])))
    length = np.diff(np.append(first, len(window)))
    a, left, begin = anchor[first], before[first], window[first]
    beside = side[np.where(left, a - SIDE_WORDS, a + ANCHOR_WORDS)]
    key = mix(g[a] * _U(0x9E3779B97F4A7C15) + beside + left.astype(_U))
    return text[first], inner[first], length, key, stretches_hash(hashes, begin, begin + length + WINDOW - 1)


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = [batch.column(c) for c in ("id", "mark_a", "mark_b")]
        for w in blocks(batch.column("text")):
            text, start, n, key, digest = anchors_of(w.hashes(), w.bounds)
            rows = pa.array(text + w.first_row)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(rows) for c in place), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(digest.view(np.int64))],
                names=["id", "mark_a", "mark_b", "start", "n", "key", "digest"],
            )


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys alone, counted as far as a block goes."""
    for batch in batches:
        for w in blocks(batch.column("text")):
            keys, times = np.unique(anchors_of(w.hashes(), w.bounds)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], names=["key", "times"])


def words_of(text: str | None) -> list[bytes]:
    """The words of one text as bytes; bytes.split knows the same six separators."""
    return (text or "").encode().split()


_CONTENT = pa.schema([
    ("id", pa.int64()), ("start", pa.int32()), ("key", pa.int64()), ("digest", pa.int64()), ("places", pa.int64()), ("at", pa.int32()), ("route", pa.int64()), ("words", pa.binary()),
])


def _content_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each merged piece (``at`` is -1), or of each of its windows where its key is hot."""
    fields = ("start", "n", "key", "digest", "places", "hot")
    for batch in batches:
        out: list[list] = [[] for _ in _CONTENT]
        held, done = 0, 0
        pieces = batch.column("pieces")
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy()).tolist()
        flat = pc.list_flatten(pieces)
        columns = [flat.field(c).to_pylist() for c in fields]
        for i, text, end in zip(batch.column("id").to_pylist(), batch.column("text"), ends, strict=True):
            words = words_of(text.as_py())
            for start, n, key, digest, places, hot in zip(*(c[done:end] for c in columns), strict=True):
                for s, size, at in [(start + k, 1, k) for k in range(n)] if hot else [(start, n, -1)]:
                    content = b" ".join(words[s : s + size + WINDOW - 1])
                    route = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True) if hot else key
                    for column, value in zip(out, (i, s, key, digest, places, at, route, content), strict=True):
                        column.append(value)
                    held += len(content)
            done = end
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _CONTENT, strict=True)], schema=_CONTENT)
                out, held = [[] for _ in _CONTENT], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _CONTENT, strict=True)], schema=_CONTENT)


def search_shard(contents: list[bytes], first: list[tuple[int, int]], window: int = WINDOW) -> list[np.ndarray]:
    """For each distinct piece, which of its windows stand earlier than in the piece's earliest place.

    Builds the index of the pieces in the order of their places (0 stands between them), then streams their
    windows through it: the matching statistics of a window that reach its whole length report an interval,
    whose earliest place is compared with the window's own.
    """
    turn = sorted(range(len(contents)), key=first.__getitem__)
    number: dict[bytes, int] = {}
    split = [contents[k].split(b" ") for k in turn]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    at = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = np.zeros(int((sizes + 1).sum()), dtype=np.int32)
    flat = np.fromiter((number.setdefault(w, len(number) + 1) for s in split for w in s), dtype=np.int32, count=int(sizes.sum()))
    del split
    inside = np.ones(len(symbols), dtype=bool)
    inside[at + sizes] = False
    symbols[inside] = flat
    index = FMIndex(symbols, len(number) + 1, window)
    # a place: (number of the id, word in the document)
    ids = np.array([first[k][0] for k in turn], dtype=np.int64)
    starts = np.array([first[k][1] for k in turn], dtype=np.int64)
    doc = np.cumsum(np.append(False, ids[1:] != ids[:-1])).astype(np.int64)

    def place(position: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return (doc[piece] << 40) + starts[piece] + position - at[piece]

    counts = sizes - window + 1
    piece = np.repeat(np.arange(len(turn)), counts)
    begin = at[piece] + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    far, lo, _ = index.matches(symbols, begin + window, window)
    earlier = np.zeros(len(begin), dtype=bool)
    full = np.flatnonzero(far == window)
    least = index.earliest(lo[full])
    earlier[full] = place(least, np.searchsorted(at, least, side="right") - 1) < place(begin[full], piece[full])
    parts = np.split(earlier, np.cumsum(counts)[:-1])
    out: list = [None] * len(turn)
    for k, found in zip(turn, parts, strict=True):
        out[k] = found
    return out


def _shard_verdicts(table: pa.Table) -> pa.Table:
    """The rows with their repeated windows, counted from the piece's first."""
    first = list(zip(table["id"].to_pylist(), table["start"].to_pylist(), strict=True))
    found = search_shard(table["words"].to_pylist(), first)
    repeats = pa.array([np.flatnonzero(f).tolist() for f in found], pa.list_(pa.int32()))
    return table.select(["id", "start", "key", "digest", "places", "at", "route"]).append_column("repeats", repeats)


def _repeat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed stretches of each piece's places: all of a later place, the repeated windows of the earliest."""
    for batch in batches:
        start, n, first_start, first_id = (batch.column(c).to_numpy() for c in ("start", "n", "first_start", "first_id"))
        later = (batch.column("id").to_numpy() != first_id) | (start != first_start)
        whole, own = np.flatnonzero(later), np.flatnonzero(~later)
        repeats = batch.column("repeats").take(pa.array(own))
        at, size = pc.list_flatten(repeats).to_numpy(), pc.fill_null(pc.list_value_length(repeats), 0).to_numpy()
        parent = np.repeat(own, size)
        # neighbouring windows of one place are one stretch
        head = np.append(True, (parent[1:] != parent[:-1]) | (at[1:] > at[:-1] + WINDOW))[: len(at)]
        first, last = np.flatnonzero(head), np.flatnonzero(np.append(head[1:], True)[: len(at)])
        rows = pa.array(np.concatenate([whole, parent[first]]))
        lo = np.concatenate([start[whole], start[parent[first]] + at[first]])
        hi = np.concatenate([start[whole] + n[whole] + WINDOW - 1, start[parent[last]] + at[last] + WINDOW])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(rows) for c in ("id", "mark_a", "mark_b")), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["id", "mark_a", "mark_b", "lo", "hi"]
        )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, texts = [], [], []
        spans = batch.column("spans")
        sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
        ends = np.cumsum(sizes)
        flat = pc.list_flatten(spans)
        lows, highs = (flat.field(c).to_numpy() for c in ("lo", "hi"))
        for text, end, size in zip(batch.column("text"), ends.tolist(), sizes.tolist(), strict=True):
            words = words_of(text.as_py())
            many, gone = len(words), 0
            if size:
                marks = np.zeros(many + 1, dtype=np.int64)
                np.add.at(marks, lows[end - size : end], 1)
                np.add.at(marks, highs[end - size : end], -1)
                keep = np.cumsum(marks[:-1]) == 0
                words = list(compress(words, keep.tolist()))
                gone = many - len(words)
            total.append(many)
            removed.append(gone)
            texts.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"]
        )


def remove_repeats(documents: DataFrame, scratch: Scratch | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by one space) of every row.

    Columns of ``documents`` but the two named are left out, whatever their names.  Texts of any length are
    judged whole; an empty table gives an empty one.
    """
    row = ["id", "mark_a", "mark_b"]  # a document: its id, and 128 bits of its text
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "substring")
    docs = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumns({"mark_a": F.xxhash64("text"), "mark_b": F.xxhash64(F.lit("b"), "text")})
    counted = docs.select("text").mapInArrow(lean(_key_rows), "key long, times long").groupBy("key").agg(F.sum("times").alias("times"))
    repeated = scratch.table(counted.where("times > 1").select("key"), "keys")
    scratch.release()
    found = docs.mapInArrow(lean(_place_rows), "id long, mark_a long, mark_b long, start int, n int, key long, digest long")
    places = scratch.table(found.join(repeated, "key"), "places")
    scratch.drop("keys")
    scratch.release()
    merged = places.groupBy("key", "digest").agg(F.min(F.struct("id", "start", "mark_a", "mark_b")).alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("places"))
    merged = scratch.table(merged.select("key", "digest", "n", "places", "first.id", "first.mark_a", "first.mark_b", "first.start"), "merged")
    scratch.release()
    crowded = merged.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > HOT_PIECES).select("key", F.lit(True).alias("hot"))
    by_doc = merged.join(crowded, "key", "left").groupBy(*row).agg(
        F.collect_list(F.struct("start", "n", "key", "digest", "places", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("pieces")
    )
    content = scratch.table(
        docs.join(by_doc, row).mapInArrow(lean(_content_rows), "id long, start int, key long, digest long, places long, at int, route long, words binary"), "content"
    )
    scratch.drop("merged")
    scratch.release()
    # windows of crowded keys: equal ones merge before they are dealt
    windows = content.where("at >= 0").withColumn("same", F.unhex(F.md5("words")))
    earliest = windows.groupBy("same").agg(F.min(F.struct("id", "start")).alias("first"), F.first("words").alias("words"), F.first("route").alias("route"))
    alone = earliest.select(
        F.col("first.id").alias("id"), F.col("first.start").alias("start"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("digest"),
        F.lit(1).cast("long").alias("places"), F.lit(0).alias("at"), "route", "words",
    )
    dealt = content.where("at < 0").unionByName(alone)
    total = dealt.agg(F.sum(F.octet_length("words")) / 6).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-int(total) // SHARD_WORDS))
    searched = scratch.table(
        dealt.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).groupBy("shard")
        .applyInArrow(_shard_verdicts, "id long, start int, key long, digest long, places long, at int, route long, repeats array<int>"), "searched"
    )
    whole = searched.where("at < 0 and (places > 1 or size(repeats) > 0)").select("key", "digest", F.col("id").alias("first_id"), F.col("start").alias("first_start"), "repeats")
    # a window of a crowded key is a repeat unless it is the earliest of its kind, and that one is no repeat in its shard
    kinds = searched.where("at >= 0").select(F.col("id").alias("e_id"), F.col("start").alias("e_start"), F.col("route").alias("e_route"), F.size("repeats").alias("later"))
    own = windows.join(earliest.select("same", "first"), "same").join(kinds, (F.col("route") == F.col("e_route")) & (F.col("first.id") == F.col("e_id")) & (F.col("first.start") == F.col("e_start")))
    again = (F.col("id") != F.col("e_id")) | (F.col("start") != F.col("e_start")) | (F.col("later") > 0)
    split = own.groupBy("key", "digest").agg(
        F.min("id").alias("first_id"), F.min(F.col("start") - F.col("at")).alias("first_start"), F.array_sort(F.collect_set(F.when(again, F.col("at")))).alias("repeats")
    )
    verdicts = scratch.table(whole.unionByName(split), "verdicts")
    scratch.drop("content")
    scratch.drop("searched")
    scratch.release()
    removed = places.join(verdicts, ["key", "digest"]).mapInArrow(lean(_repeat_rows), "id long, mark_a long, mark_b long, lo int, hi int")
    spans = scratch.table(removed.groupBy(*row).agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    for name in ("places", "verdicts"):
        scratch.drop(name)
    scratch.release()
    joined = docs.join(spans, row, "left").select("id", "text", "spans")
    kept = joined.mapInArrow(lean(_kept), "id long, n_words long, n_removed long, kept string")
    return kept.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")
