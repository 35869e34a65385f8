"""Periodic runs in word sequences by an all-lag scan.

A run is a maximal stretch of consecutive words whose smallest period is q and whose length is at least
``min_length`` and ``min_exp`` periods.  For every lag q up to n / min_exp the array of word numbers is compared
with itself shifted by q; a stretch of equal places is a stretch with period q, and it is a run if its first q
words are no repetition of fewer words.

Short texts are scanned together: their word numbers stand in one array, longest text first, with a number of its
own after each, so that no stretch reaches over an end, and a lag looks only at the texts that are long enough for
it.  A long text is cut by lag: Spark deals (text, lag range) rows over the machines, which share the work of one
text, and gathers its runs again.  The ranges are planned from the text's bytes; the plan changes no result.

A null text has no words.  Rows are told apart by id and text, so repeated rows and ids, and null ids, each give
their row.  No word is left out, whatever the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.memory import lean
from lodestone.llm.words import SEPARATORS, Words, blocks

MIN_EXP = 4
MIN_LENGTH = 6
#: Comparisons of one lag range, and at least so many for each word that is sent along with it.
RANGE_COST = 1 << 24
RANGE_COST_A_WORD = 1 << 12
#: Bytes of a word with its separator, for the plan of ranges.
WORD_BYTES = 6

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SEPARATOR = np.isin(np.arange(256), SEPARATORS)


def word_ids(words: Words) -> np.ndarray:
    """A number for each word of the block, equal for equal words only."""
    sizes = words.ends - words.starts
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    body = words.data[~_SEPARATOR[words.data]]
    column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False)


@lru_cache(maxsize=1 << 14)
def prime_factors(q: int) -> tuple[int, ...]:
    found, k = [], 2
    while k * k <= q:
        if q % k == 0:
            found.append(k)
            while q % k == 0:
                q //= k
        k += 1
    return (*found, q) if q > 1 else tuple(found)


def is_primitive(block: np.ndarray) -> bool:
    """Whether ``block`` is no repetition of a shorter block."""
    q = len(block)
    return not any(np.array_equal(block[q // r :], block[: q - q // r]) for r in prime_factors(q))


def scan(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, lags: range, min_exp: int, min_length: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, start, length, period) of the runs whose period is in ``lags``.

    Texts stand in ``flat`` from ``begins`` on, longest first, each followed by a number that stands nowhere else.
    """
    rising = sizes[::-1]
    for q in lags:
        texts = len(sizes) - int(np.searchsorted(rising, max(min_length, min_exp * q)))
        if not texts:
            return
        end = int(begins[texts - 1] + sizes[texts - 1])
        least = max(min_length, min_exp * q) - q
        same = flat[q:end] == flat[: end - q]
        # places from which 2, then 4 in a row are equal: mostly none, and then there is no long stretch
        window = same[:-1] & same[1:] if least >= 2 else same
        if least >= 4:
            window = window[:-2] & window[2:]
        if not window.any():
            continue
        edges = np.flatnonzero(np.diff(same.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= least
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            text = int(np.searchsorted(begins, s, side="right")) - 1
            if s + q < begins[text] + sizes[text] and is_primitive(flat[s : s + q]):
                yield text, s - int(begins[text]), e - s + q, q


def block_runs(words: Words, ids: np.ndarray, share: list[tuple[int, int]], min_exp: int, min_length: int) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text; text i is scanned for part k of n of its lags, (k, n) = share[i]."""
    n_texts = len(words)
    sizes = np.diff(words.bounds)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(n_texts)]
    groups: dict[tuple[int, int, int], list[int]] = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        k, n = share[i]
        groups.setdefault((k, n, i if n > 1 else 0), []).append(i)
    for (k, n, _), texts in groups.items():
        own = sizes[texts]
        kind = np.uint16 if len(ids) and int(ids.max()) + len(texts) + 1 < 1 << 16 else np.uint32
        last = int(ids.max()) + 1 if len(ids) else 0
        flat = np.empty(int(own.sum()) + len(texts), dtype=kind)
        begins = np.zeros(len(texts), dtype=np.int64)
        np.cumsum(own[:-1] + 1, out=begins[1:])
        for j, i in enumerate(texts):
            b = int(begins[j])
            flat[b : b + int(own[j])] = ids[words.bounds[i] : words.bounds[i + 1]]
            flat[b + int(own[j])] = last + j
        most = int(own[0]) // min_exp
        for j, *run in scan(flat, begins, own, range(1 + most * k // n, 1 + most * (k + 1) // n), min_exp, min_length):
            runs[texts[j]].append(tuple(run))
    for found in runs:
        found.sort(key=lambda r: (r[0], r[2]))
    return runs


def collapse(words: Words, runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    """Each text's words joined by one space, without those that a run has after its first period."""
    keep = np.ones(len(words.starts), dtype=bool)
    for i, found in enumerate(runs):
        base = int(words.bounds[i])
        for start, length, period in found:
            keep[base + start + period : base + start + length] = False
    kept = np.flatnonzero(keep)
    starts, sizes = words.starts[kept], (words.ends - words.starts)[kept]
    text = np.searchsorted(words.bounds, kept, side="right") - 1
    gap = np.ones(len(kept), dtype=np.int64)  # a space before each word but a text's first
    gap[:1] = 0
    gap[1:][text[1:] != text[:-1]] = 0
    ends = np.cumsum(sizes + gap)
    before = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum()), dtype=np.int64)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
    out[at + np.repeat(ends - sizes - before, sizes)] = words.data[at + np.repeat(starts - before, sizes)]
    offsets = np.concatenate([[0], ends])[np.searchsorted(kept, words.bounds)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())


def _scan_rows(batches: Iterator[pa.RecordBatch], min_exp: int, min_length: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) with all lags to their runs and collapsed text."""
    for batch in batches:
        for words in blocks(batch.column("text")):
            runs = block_runs(words, word_ids(words), [(0, 1)] * len(words), min_exp, min_length)
            yield _result(batch.column("id").slice(words.first_row, len(words)), words, runs)


def _result(ids: pa.Array, words: Words, runs: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    found = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], pa.list_(_RUN))
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(words.bounds), pa.int64()), found, collapse(words, runs)], names=["id", "n_words", "runs", "collapsed"])


def _scan_ranges(batches: Iterator[pa.RecordBatch], min_exp: int, min_length: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, mark, text, part, parts) to the runs of that part of the lags; part 0 carries the text on."""
    for batch in batches:
        share = list(zip(batch.column("part").to_pylist(), batch.column("parts").to_pylist(), strict=True))
        for words in blocks(batch.column("text"), max_bytes=1):
            i = words.first_row
            (found,) = block_runs(words, word_ids(words), [share[i]], min_exp, min_length)
            one = batch.slice(i, 1)
            text = one.column("text") if share[i][0] == 0 else pa.nulls(1, pa.string())
            runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found]], pa.list_(_RUN))
            yield pa.RecordBatch.from_arrays([one.column("id"), one.column("mark"), text, runs], names=["id", "mark", "text", "runs"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in blocks(batch.column("text"), max_bytes=1):
            found = {(r["start"], r["length"], r["period"]) for r in batch.column("runs")[words.first_row].as_py()}
            yield _result(batch.column("id").slice(words.first_row, 1), words, [sorted(found, key=lambda r: (r[0], r[2]))])


def find_runs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH, range_cost: int = RANGE_COST) -> DataFrame:
    """id, n_words, runs (start, length, period; by start, then period) and collapsed of each row of ``documents``.

    ``min_exp`` is at least 2, so that a stretch with two periods has the smaller one's divisor as its period.
    """
    if min_exp < 2 or min_length < 2:
        raise ValueError("a run has at least two periods and two words")
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    n = F.coalesce(F.octet_length("text"), F.lit(0)) / WORD_BYTES
    parts = F.ceil(n * n / min_exp / F.greatest(F.lit(float(range_cost)), n * min(RANGE_COST_A_WORD, range_cost)))
    id_type = rows.schema["id"].dataType.simpleString()
    out = f"id {id_type}, n_words long, runs {RUNS}, collapsed string"
    whole = rows.where(parts <= 1).mapInArrow(lean(lambda it: _scan_rows(it, min_exp, min_length)), out)
    cut = rows.where(parts > 1).select("id", F.sha2(F.encode("text", "UTF-8"), 256).alias("mark"), "text", parts.cast("long").alias("parts"))
    dealt = cut.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    width = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = dealt.repartition(width, "id", "mark", "part").mapInArrow(lean(lambda it: _scan_ranges(it, min_exp, min_length)), f"id {id_type}, mark string, text string, runs {RUNS}")
    # rows that are equal in id and text share their runs, and each gives a row
    gathered = ranges.groupBy("id", "mark").agg(F.max("text").alias("text"), F.flatten(F.collect_list("runs")).alias("runs"), F.count("text").alias("copies"))
    each = gathered.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("id", "text", "runs")
    return whole.union(each.mapInArrow(lean(_gathered), out))
