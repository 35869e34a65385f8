"""Supervised subword embeddings for document quality.

A document is the mean of learned vectors of its hashed words, word pairs (pairs of equal words share
one vector for each distance up to 3) and character n-grams (3 to 5 bytes of a word with its borders); a softmax layer scores the classes.  Training is plain
stochastic gradient descent in NumPy over a bounded sample of labelled rows, inside one task; the
model that comes back is a table of fixed size.  Because the mean and the layer are both linear, the
score of a document needs one number a bucket: the difference of the two classes' logits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.memory import lean
from lodestone.llm.words import SEPARATORS, Words, blocks, mix, split

_U = np.uint64
#: A byte's code inside a word; separators are 0.
_CODE = np.arange(1, 257, dtype=np.uint32)
_CODE[list(SEPARATORS)] = 0


@dataclass(frozen=True)
class Settings:
    """Parameters of the classifier; ``train_rows`` and ``train_features`` (distinct buckets of all rows together)
    bound the labelled sample that it is fitted on, whatever the length of its texts."""

    bits: int = 17
    dim: int = 8
    epochs: int = 5
    rate: float = 0.5
    train_rows: int = 4000
    train_features: int = 24_000_000
    seed: int = 7


def _features(w: Words, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of features as (bucket, byte position); every text also has one constant feature, not listed."""
    shift = _U(64 - bits)
    h = w.hashes()
    if len(h):
        yield (h >> shift).astype(np.int64), w.starts
        row = np.repeat(np.arange(len(w)), np.diff(w.bounds))
        for lag in (1, 2, 3):  # a word pair; of equal words, one pair for all words: repetition
            if len(h) > lag:
                here = np.flatnonzero((row[lag:] == row[:-lag]) & ((lag == 1) | (h[lag:] == h[:-lag])))
                pair = mix(np.where(h[here] == h[here + lag], _U(lag), h[here] * _U(0x9E3779B97F4A7C15) + h[here + lag]))
                yield (pair >> shift).astype(np.int64), w.starts[here]
    n = len(w.data)
    code = np.zeros(n + 2, dtype=np.uint32)  # with a border before and after
    code[1:-1] = _CODE[w.data]
    inside = code > 0
    for size in (3, 4, 5):
        m = n + 2 - size + 1
        if m <= 0:
            continue
        g = code[:m].copy()
        ok = np.ones(m, dtype=bool)
        for k in range(1, size):
            g = g * np.uint32(0x01000193) + code[k : k + m]
            if k < size - 1:
                ok &= inside[k : k + m]
        g = (g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * size)
        g ^= g >> np.uint32(13)
        at = np.flatnonzero(ok)
        yield (g[at] >> np.uint32(32 - bits)).astype(np.int64), at


def _row_of(w: Words, at: np.ndarray) -> np.ndarray:
    """The text that a byte position belongs to; the border before a text counts with the text."""
    return np.minimum(np.searchsorted(w.text_bounds[1:-1], np.minimum(at, max(len(w.data) - 1, 0)), side="right"), len(w) - 1)


def _spaced(column: pa.Array) -> Iterator[Words]:
    """Blocks of texts with a space between, so that no n-gram spans two texts."""
    for w in blocks(column):
        rows = len(w)
        sizes = np.diff(w.text_bounds)
        at = np.arange(len(w.data)) + np.repeat(np.arange(rows), sizes)
        data = np.full(len(w.data) + rows, 0x20, dtype=np.uint8)
        data[at] = w.data
        bounds = w.text_bounds + np.arange(rows + 1)
        yield split(data, bounds, w.first_row)


def sparse(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares of all its features, the constant one included."""
    constant = 1 << bits
    for w in _spaced(column):
        parts = [(_row_of(w, at), bucket) for bucket, at in _features(w, bits)]
        row = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)])
        bucket = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
        order = np.argsort(row, kind="stable")
        row, bucket = row[order], bucket[order]
        cuts = np.searchsorted(row, np.arange(len(w) + 1))
        for k in range(len(w)):
            ids, counts = np.unique(np.append(bucket[cuts[k] : cuts[k + 1]], constant), return_counts=True)
            yield ids.astype(np.int32), (counts / counts.sum()).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Train, and fold the two layers: one log-odds number for each bucket."""
    rng = np.random.default_rng(s.seed)
    table = rng.uniform(-1 / s.dim, 1 / s.dim, ((1 << s.bits) + 1, s.dim)).astype(np.float32)
    layer = np.zeros((2, s.dim), dtype=np.float32)
    steps, done = max(1, s.epochs * len(rows)), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            ids, share, label = rows[k]
            rate = np.float32(s.rate * (1 - done / steps))
            done += 1
            mean = share @ table[ids]
            logits = layer @ mean
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, mean).astype(np.float32)
            table[ids] -= rate * np.outer(share * np.float32(len(ids)) ** 0.5, back).astype(np.float32)
    return (table @ (layer[1] - layer[0])).astype(np.float32)


def train(labelled: DataFrame, settings: Settings = Settings(), text: str = "text", label: str = "label", order: str = "order") -> np.ndarray:
    """Fit on at most ``train_rows`` rows of (text, label 0 or 1, order), those lowest in ``order``.

    Rows with another or no label are left out; without any row the model is all zeros (score 0.5).
    """
    bits = settings.bits
    sample = labelled.where(F.col(label).isin(0, 1)).select(text, F.col(label).cast("int").alias("label"), F.col(order).alias("order"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shares = zip(*sparse(batch.column(0), bits), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in shares], pa.binary()), batch.column(1), batch.column(2)],
                names=["ids", "shares", "label", "order"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                held += len(r["ids"]) // 4
                if held <= settings.train_features:
                    rows.append((np.frombuffer(r["ids"], np.int32), np.frombuffer(r["shares"], np.float32), r["label"]))
        model = fit(rows, settings) if rows else np.zeros((1 << bits) + 1, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], names=["model"])

    kind = sample.schema["order"].dataType
    schema = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("shares", T.BinaryType()), T.StructField("label", T.IntegerType()), T.StructField("order", kind)])
    # the sample is bounded, so one task can hold it
    found = sample.mapInArrow(lean(featurise), schema).repartition(1).sortWithinPartitions("order", "label", "ids").mapInArrow(lean(learn), "model binary").collect()
    return np.frombuffer(found[0].model, np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def score(df: DataFrame, model: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 of every whole text (null and empty: of the constant alone)."""
    df = df.drop(out)
    bits = (len(model) - 1).bit_length() - (0 if (len(model) - 1) & (len(model) - 2) else 1)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            out_scores = np.empty(batch.num_rows)
            for w in _spaced(batch.column(text)):
                sums = np.full(len(w), float(weights[-1]))
                counts = np.ones(len(w))
                for bucket, at in _features(w, bits):
                    row_cuts = np.searchsorted(at, np.append(w.text_bounds[:-1], len(w.data) + 1))
                    total = np.concatenate([[0.0], np.cumsum(weights[bucket], dtype=np.float64)])
                    sums += total[row_cuts[1:]] - total[row_cuts[:-1]]
                    counts += np.diff(row_cuts)
                out_scores[w.first_row : w.first_row + len(w)] = 1 / (1 + np.exp(-np.clip(sums / counts, -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out_scores)], names=[*batch.schema.names, out])

    return df.mapInArrow(lean(run), schema)


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: the CRC-32 of the id's decimal text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def labelled_sample(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """At most ``train_rows`` labelled documents outside the held-out fold, spread evenly by a hash of the id."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("label"))
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id").limit(settings.train_rows)
    )
    # bounded by train_rows: safe to broadcast
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "order")


def quality_scores(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """doc_id, text, held_out, score, predicted for every row of ``documents``; other columns are left out.

    A row with a null id is scored like any other and counts as not held out.
    """
    model = train(labelled_sample(documents, labels, settings), settings)
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
