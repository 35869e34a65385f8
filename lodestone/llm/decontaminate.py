"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

The index is inverted: a term's postings carry its impact in each item, as a share of the item's score
for its own text, so one threshold fits all items.  Items lie in blocks, with the largest impact of a
term in each block, and retrieval is block-max WAND, for many passages at once: a passage whose terms'
list maxima cannot sum to the threshold is skipped; of the others, only blocks that hold a term from the
passage's pivot on are looked at, and of these only those whose block maxima can sum to it; what is left is
scored in full, and every item at or above the threshold is returned.  A hit counts when the passage
holds at least 0.8 of the question's and of the answer's word 5-grams.

Passages are as long as two of the longest item and begin every such length, so no item is cut.  The
answer of an item is its last line, or else its last sentence, or else its last quarter of words.
Comparison is loose: A-Z fold, and ASCII characters other than letters and digits separate words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.memory import lean
from lodestone.llm.words import LOOSE, blocks, ngrams
from lodestone.runtime import Scratch

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE_WORDS = 0.5, 0.8, 5
BLOCK_ITEMS = 8
#: Items indexed at once, and characters of text; more are worked off in several passes.
PASS_ITEMS, PASS_CHARS = 4096, 8 << 20
#: Cells of passages and blocks that are held at once.
MOST_CELLS = 4 << 20
_U = np.uint64


def loose_words(text: str | None) -> np.ndarray:
    """Hashes of a text's words."""
    for w in blocks(pa.array([text or ""]), separators=LOOSE):
        return w.hashes(fold=True)
    return np.zeros(0, _U)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer."""
    text = text.strip()
    for mark in (r"\n+", r"(?<=[.!?])\s+"):
        parts = [p for p in re.split(mark, text) if loose_words(p).size]
        if len(parts) > 1:
            return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    return np.unique(ngrams(h, min(size, len(h)))) if len(h) else h


@dataclass(frozen=True)
class Statistics:
    """What BM25 knows of all items that have a word, for the terms (sorted) of some of them."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """The inverted index of some items; items without a word are left out.

    Without ``statistics`` these items are all there are.
    """

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        rows = [(i, loose_words(t), split_item(t or "")) for i, t in items]
        rows = [r for r in rows if len(r[1])]
        rows.sort(key=lambda r: (len(np.unique(r[1])), r[0] is None, r[0] or 0))
        self.ids = [r[0] for r in rows]
        self.longest = max((len(r[1]) for r in rows), default=1)
        self.parts = [tuple((len(h), shingles(h, SHINGLE_WORDS)) for h in map(loose_words, r[2])) for r in rows]
        self.terms = np.unique(np.concatenate([r[1] for r in rows])) if rows else np.zeros(0, _U)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.terms >> _U(48)).astype(np.int64)] = True
        n, v = len(rows), len(self.terms)
        tf = [np.unique(np.searchsorted(self.terms, r[1]), return_counts=True) for r in rows]
        df = np.bincount(np.concatenate([t for t, _ in tf]), minlength=v) if rows else np.zeros(0)
        mean = np.mean([len(r[1]) for r in rows]) if rows else 1.0
        if statistics and rows:
            n, mean, self.longest = statistics.n, statistics.mean, statistics.longest
            df = statistics.df[np.searchsorted(statistics.terms, self.terms)]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        term, item, impact = [], [], []
        for k, (t, f) in enumerate(tf):
            own = idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(rows[k][1]) / mean))
            term.append(t)
            item.append(np.full(len(t), k))
            impact.append(own / own.sum())
        self.n_blocks = -(-len(rows) // BLOCK_ITEMS)
        self.term, self.item, self.impact = (np.concatenate(x) if rows else np.zeros(0) for x in (term, item, impact))
        # postings by (block, term): their items' impacts as a dense row of the block
        cell = (self.item // BLOCK_ITEMS).astype(np.int64) * v + self.term.astype(np.int64)
        self.cells, inverse = np.unique(cell, return_inverse=True)
        self.rows = np.zeros((len(self.cells) + 1, BLOCK_ITEMS), dtype=np.float32)
        if rows:
            self.rows[inverse, self.item.astype(np.int64) % BLOCK_ITEMS] = self.impact
        self.cell_max = self.rows.max(axis=1)
        self.list_max = np.zeros(v, dtype=np.float32)
        if rows:
            np.maximum.at(self.list_max, self.term.astype(np.int64), self.impact.astype(np.float32))
        # a term's blocks, one after another
        by_term = np.argsort(self.cells % max(v, 1), kind="stable")
        self.term_cells = by_term
        self.term_bounds = np.searchsorted((self.cells % max(v, 1))[by_term], np.arange(v + 1))
        self.cell_block = (self.cells // max(v, 1)).astype(np.int64)

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (passage, item, score) at or above the threshold; input are distinct pairs sorted by passage."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        slack = threshold - 1e-5
        if not len(passage):
            return none
        # each passage's terms from the least list maximum on: its pivot is the first term up to which the maxima sum
        # to the threshold, and an item without a term from the pivot on cannot reach it
        order = np.lexsort((self.list_max[term], passage))
        passage, term = passage[order], term[order]
        head = np.append(True, passage[1:] != passage[:-1])
        total = np.cumsum(self.list_max[term].astype(np.float64))
        row = np.cumsum(head) - 1
        before = np.append(0.0, total)[np.flatnonzero(head)]
        essential = total - before[row] >= slack - 1e-9
        keep = np.append(np.flatnonzero(head)[1:], len(passage)) - 1  # the last sum is the largest
        kept = essential[keep][row]
        passage, term, essential = passage[kept], term[kept], essential[kept]
        found, lo = [], 0
        most = max(1, MOST_CELLS // max(self.n_blocks, 1))
        while lo < len(passage):  # whole passages, a bounded number of terms and of passage-block cells at a time
            hi = min(lo + (1 << 19), len(passage))
            if hi < len(passage):
                hi = int(np.searchsorted(passage, passage[hi], side="left"))
                hi = hi if hi > lo else int(np.searchsorted(passage, passage[lo], side="right"))
            starts = lo + np.flatnonzero(np.append(True, passage[lo + 1 : hi] != passage[lo : hi - 1]))
            hi = int(starts[most]) if len(starts) > most else hi
            found.append(self._evaluate(passage[lo:hi], term[lo:hi], essential[lo:hi], slack))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none

    def _cells(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks' cells of each of some terms, and how many each has."""
        many = self.term_bounds[term + 1] - self.term_bounds[term]
        return self.term_cells[np.repeat(self.term_bounds[term], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)], many

    def _evaluate(self, passage: np.ndarray, term: np.ndarray, essential: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers, dense = np.unique(passage, return_inverse=True)
        cell, many = self._cells(term[essential])
        key = np.repeat(dense[essential], many) * self.n_blocks + self.cell_block[cell]
        alive = np.zeros(len(numbers) * self.n_blocks, dtype=bool)
        alive[key] = True  # blocks that a passage meets from its pivot on; the other terms count only there
        rest, many = self._cells(term[~essential])
        rest_key = np.repeat(dense[~essential], many) * self.n_blocks + self.cell_block[rest]
        pick = alive[rest_key]
        key, cell = np.concatenate([key, rest_key[pick]]), np.concatenate([cell, rest[pick]])
        bound = np.bincount(key, weights=self.cell_max[cell], minlength=len(alive))
        pick = (bound >= slack)[key]
        key, cell = key[pick], cell[pick]
        if not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(key, kind="stable")
        key, cell = key[order], cell[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        scores = np.add.reduceat(self.rows[cell].astype(np.float64), head, axis=0)
        at, lane = np.nonzero(scores >= slack)
        pair = key[head][at]
        return numbers[pair // self.n_blocks], (pair % self.n_blocks) * BLOCK_ITEMS + lane, scores[at, lane]


def passages(h: np.ndarray, bounds: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (passage, term) pairs of texts side by side, and each passage's first word."""
    size = index.longest
    sizes = np.diff(bounds)
    cuts = np.maximum(1, -(-sizes // size) - 1) * (sizes > 0)  # passages of a text: windows of two sizes
    begin = np.cumsum(cuts) - cuts
    word = np.flatnonzero(index.maybe[(h >> _U(48)).astype(np.int64)]) if len(index.terms) else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(index.terms, h[word]), max(len(index.terms) - 1, 0))
    hit = index.terms[at] == h[word] if len(index.terms) else np.zeros(0, bool)
    word, at = word[hit], at[hit]
    text = np.searchsorted(bounds, word, side="right") - 1
    piece = (word - bounds[text]) // size
    last = cuts[text] - 1
    here, before = np.minimum(piece, last), np.minimum(piece - 1, last)
    two = (before >= 0) & (before != here)
    v = max(len(index.terms), 1)
    pair = np.concatenate([(begin[text] + here) * v + at, (begin[text] + before)[two] * v + at[two]])
    pair = np.unique(pair)
    starts = np.repeat(bounds[:-1], cuts) + (np.arange(int(cuts.sum())) - np.repeat(begin, cuts)) * size
    return pair // v, pair % v, starts


def search_block(h: np.ndarray, bounds: np.ndarray, index: Index, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """Verified hits as (text, item number, best score, question share, answer share)."""
    passage, term, starts = passages(h, bounds, index)
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p, item, score in zip(*(x.tolist() for x in index.retrieve(passage, term, threshold)), strict=True):
        text = int(np.searchsorted(bounds, starts[p], side="right")) - 1
        own = h[starts[p] : min(starts[p] + 2 * index.longest, bounds[text + 1])]
        shares, grams = [], {}
        for length, wanted in index.parts[item]:
            n = min(SHINGLE_WORDS, length)
            if n and n not in grams:
                grams[n] = ngrams(own, n)
            shares.append(float(np.isin(wanted, grams[n]).mean()) if n else 1.0)
        if min(shares) >= overlap:
            found[text, item] = max(found.get((text, item), (0.0, 0.0, 0.0)), (score, *shares))
    return [(t, i, *x) for (t, i), x in sorted(found.items())]


MATCH = "array<struct<item_id:bigint,bm25:double,question:double,answer:double>>"


def item_passes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The test items, a bounded number and size at a time."""
    part, chars = [], 0
    for row in items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
        if part and (len(part) >= PASS_ITEMS or chars + len(row.t or "") > PASS_CHARS):
            yield part
            part, chars = [], 0
        part.append((row.i, row.t))
        chars += len(row.t or "")
    yield part


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and distinct terms of each item."""
    for batch in batches:
        words = [loose_words(t.as_py()) for t in batch.column(0)]
        terms = pa.array([np.unique(h).view(np.int64) for h in words], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([len(h) for h in words], pa.int64()), terms], names=["size", "terms"])


def pass_statistics(items: DataFrame, parts: Iterator[list[tuple[int, str]]], text: str = "text") -> Iterator[tuple[list[tuple[int, str]], Statistics]]:
    """Each pass with the statistics of all items, for its own terms."""
    spark = items.sparkSession
    each = items.select(text).mapInArrow(_item_terms, "size long, terms array<long>").where("size > 0")
    n, words, longest = each.agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
    scratch = Scratch(spark, "items")
    counted = scratch.table(each.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    for part in parts:
        hashes = [loose_words(t) for _, t in part]
        own = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, _U)
        wanted = spark.createDataFrame(pa.table({"term": pa.array(own.view(np.int64))}))
        found = counted.join(wanted, "term").toArrow()  # a row each term of this pass
        terms = found.column("term").to_numpy().view(_U)
        order = np.argsort(terms)
        yield part, Statistics(n, (words or 0) / max(n, 1), longest or 1, terms[order], found.column("df").to_numpy()[order])
    scratch.drop()


def find_items(documents: DataFrame, items: DataFrame, text: str = "text", out: str = "matches", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``documents`` with the test items that each whole text holds (an empty array for clean ones).

    Null and empty texts hold none; a column named as ``out`` is replaced.  Nothing is shuffled.  Where the items
    take several passes, each pass writes its table before the next, so a task never holds more than one index.
    """
    documents = documents.drop(out).withColumn(out, F.array().cast(MATCH))
    parts = item_passes(items)
    ahead = list(islice(parts, 2))
    if len(ahead) == 1:
        return _one_pass(documents, ahead[0], None, text, out, threshold, overlap)
    scratch = Scratch(documents.sparkSession, "passes")
    for k, (part, statistics) in enumerate(pass_statistics(items, chain(ahead, parts))):
        documents = scratch.table(_one_pass(documents, part, statistics, text, out, threshold, overlap), f"pass-{k}")
        if k:
            scratch.drop(f"pass-{k - 1}")
    return documents


def _one_pass(documents: DataFrame, part: list[tuple[int, str]], statistics: Statistics | None, text: str, out: str, threshold: float, overlap: float) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast((part, statistics))
    names, built = documents.columns, {}
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("bm25", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = built.get("index") or built.setdefault("index", Index(*shared.value))
        for batch in batches:
            hits = batch.column(names.index(out)).to_pylist()
            for w in blocks(batch.column(names.index(text)), separators=LOOSE):
                for t, item, score, q, a in search_block(w.hashes(fold=True), w.bounds, index, threshold, overlap):
                    hits[w.first_row + t].append({"item_id": index.ids[item], "bm25": score, "question": q, "answer": a})
            columns = list(batch.columns)
            columns[names.index(out)] = pa.array(hits, kind)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.mapInArrow(lean(run), documents.schema)


def contaminated(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, bm25, question, answer: a row for each item found in each document."""
    hits = find_items(documents.select(doc_id, text), items, text)
    return hits.select(doc_id, F.explode("matches").alias("m")).select(doc_id, "m.*")
