"""Vector retrieval: embedding providers, exact cosine search, the best chunk of each file."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import analyze
from lodestone.functions.memory import give_back
from lodestone.functions.rowlocal import chunks

#: The size of an embedding, and the tokens an encoder reads of a chunk.
EMBED_DIM, ENCODER_TOKENS = 384, 512
#: Vectors and queries of one cell, and scores of one matrix product (8 bytes each).
STORED_ROWS, QUERY_ROWS, CELL_SCORES = 1 << 14, 1 << 10, 1 << 20


class HashedWords:
    """The provider without a model: hashed word counts, scaled to length 1."""

    def __init__(self, dim: int = EMBED_DIM):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for k, text in enumerate(texts):
            words = re.findall(r"\w+", (text or "").lower())
            h = np.fromiter(map(_crc, words), np.int64, len(words))
            out[k] = np.bincount((h >> 1) % self.dim, np.where(h & 1, 1.0, -1.0), self.dim)
        return _unit(out)


@lru_cache(1 << 18)
def _crc(word: str) -> int:
    return zlib.crc32(word.encode())


class OnnxEncoder:
    """A sentence encoder from a folder with ``model.onnx`` (or ``model_quantized.onnx``) and ``tokenizer.json``.

    Tokens are cut at 512, padded to the longest of the batch; the last hidden states are averaged under
    the mask and scaled to length 1.
    """

    def __init__(self, folder: str):
        import os

        import onnxruntime
        from tokenizers import Tokenizer

        name = next(n for n in ("model.onnx", "model_quantized.onnx") if os.path.exists(os.path.join(folder, n)))
        self.session = onnxruntime.InferenceSession(os.path.join(folder, name))
        self.tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
        self.tokenizer.enable_truncation(ENCODER_TOKENS)
        self.tokenizer.enable_padding()

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, EMBED_DIM), np.float32)
        rows = self.tokenizer.encode_batch([t or "" for t in texts])
        ids, mask, kinds = (np.array([getattr(r, a) for r in rows], dtype=np.int64) for a in ("ids", "attention_mask", "type_ids"))
        names = {i.name for i in self.session.get_inputs()}
        feed = {k: v for k, v in (("input_ids", ids), ("attention_mask", mask), ("token_type_ids", kinds)) if k in names}
        return mean_pool(self.session.run(None, feed)[0], mask)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    weight = mask[:, :, None].astype(np.float32)
    return _unit((states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm > 1e-10, x / np.maximum(norm, 1e-10), x).astype(np.float32)


def find_model(*folders: str) -> str | None:
    """The first folder that holds a model and a tokenizer."""
    import os

    for folder in folders:
        if folder and os.path.exists(os.path.join(folder, "tokenizer.json")) and any(os.path.exists(os.path.join(folder, n)) for n in ("model.onnx", "model_quantized.onnx")):
            return folder
    return None


def embed_files(files: DataFrame, provider: Callable[[], object], path: str = "relative_path", content: str = "content") -> DataFrame:
    """A row for each chunk of each file, with its embedding; one provider a worker process."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for texts in batches:
            yield pd.Series(list(model.embed(texts.tolist())))

    cut = files.select(F.col(path).alias("relative_path"), F.posexplode(chunks(F.col(content))).alias("chunk_idx", "chunk"))
    return cut.select("relative_path", "chunk_idx", "chunk.off", "chunk.len", "chunk.text", embed("chunk.text").alias("embedding"))


def cosine_scores(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """``vectors`` with their cosine similarity to the query; none for a zero query or another size."""
    if not any(query):
        return vectors.withColumn("score", F.lit(0.0)).where("false")
    return vectors.where(F.size(column) == len(query)).withColumn("score", analyze.cosine_to(F.col(column), query))


def _best_of_cell(stored: pa.Table, asked: pa.Table, k: int, digits: int | None) -> pa.Table:
    """The k best vectors of a cell for each of its queries, by matrix products for each size of vector."""
    out: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
    if stored.num_rows and asked.num_rows:
        stored, asked = stored.sort_by("key"), asked.combine_chunks()
        sizes = [pc.list_value_length(t.column("vector")).combine_chunks().to_numpy(zero_copy_only=False) for t in (stored, asked)]
        for dims in np.intersect1d(*sizes).tolist():
            x, q = (t.filter(pa.array(n == dims)) for t, n in zip((stored, asked), sizes, strict=True))
            a, b = (t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims) for t in (x, q))
            long_a, long_b, some = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1), max(1, CELL_SCORES // len(a))
            keys, names, zeros = x.column("key").combine_chunks(), q.column("query").combine_chunks(), ~b.any(axis=1)
            for lo in range(0, len(b), some):  # some queries at a time, so that few scores stand in memory at once
                scores = b[lo : lo + some] @ a.T
                scale = long_b[lo : lo + some, None] * long_a[None, :]
                scores = np.divide(scores, scale, out=np.zeros_like(scores), where=scale > 0)
                scores = scores if digits is None else np.round(scores, digits, out=scores)
                for row, name, zero in zip(scores, names[lo : lo + some], zeros[lo : lo + some], strict=True):
                    if not zero:
                        near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                        near = near[np.argsort(-row[near], kind="stable")][:k]  # rows are in the order of their keys
                        out.append((pa.repeat(name, len(near)), keys.take(pa.array(near)), row[near]))
    columns = {"query": [o[0] for o in out], "key": [o[1] for o in out]}
    empty = {"query": asked.schema.field("query").type, "key": stored.schema.field("key").type}
    return pa.table({n: pa.concat_arrays(c) if c else pa.array([], empty[n]) for n, c in columns.items()} | {"score": np.concatenate([o[2] for o in out]) if out else np.zeros(0)})


def batch_top_k(
    stored: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query: str = "query_id", column: str = "embedding", digits: int | None = None,
    stored_rows: int = STORED_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query, rank (from 1), key, score: the k vectors of the largest cosine for each of many query vectors, exactly.

    Both sides are dealt in blocks, and each cell of a block with a block is a matrix product, of which k rows a query
    go on; a task holds one cell.  A zero vector has similarity 0, a zero query or one of another size finds nothing,
    ties go to the smaller key.  ``digits`` rounds scores before they are compared.
    """
    x = stored.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).alias("vector"))
    q = queries.where(F.col(column).isNotNull()).select(F.col(query).alias("query"), F.col(column).alias("vector"))
    blocks, turns = (max(1, -(-df.count() // n)) for df, n in ((x, stored_rows), (q, query_rows)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x, q = x.withColumn("block", deal("key", blocks)).withColumn("turn", all_of(turns)), q.withColumn("turn", deal("query", turns)).withColumn("block", all_of(blocks))
    kinds = {n: df.schema[n].dataType.simpleString() for n, df in (("query", q), ("key", x))}

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return _best_of_cell(a, b, k, digits)
        finally:
            give_back()

    found = x.groupBy("block", "turn").cogroup(q.groupBy("block", "turn")).applyInArrow(best, f"query {kinds['query']}, key {kinds['key']}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias(query), "rank", F.col("key").alias(key), "score")


def best_per_key(scored: DataFrame, key: str, carry: str, *more: str) -> DataFrame:
    """Each key's best score, and what goes with it (of equal scores the smaller ``carry``)."""
    best = F.max_by(F.struct("score", carry, *more), F.struct(F.col("score"), -F.col(carry)))
    return scored.groupBy(key).agg(best.alias("best")).select(key, "best.score", *(f"best.{c}" for c in (carry, *more)))
