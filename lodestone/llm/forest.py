"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Each of ``trees`` trees names every vector by a long string of symbols.  A symbol is the axis, with its sign, that
is largest among ``SYMBOL_DIMS`` coordinates of a random rotation; near vectors share it more often than others.  A
tree is the sorted array of these strings, kept in shards by their first symbols, and the vectors that share a
prefix with a query are an interval of it.  A query descends in every tree to its longest matches and then ascends
in all trees together, one symbol at a time and tree by tree, until it has met a number of candidates, counted with
repetitions, that ``wanted`` gives as a power of the number of vectors.  Those candidates are compared exactly, in
double precision, and the best are kept.  Queries that shards of the planned depth cannot satisfy are searched in
shards of fewer symbols, at last in whole trees, so that no query gets fewer candidates than asked for.

For the largest inner product, vectors are hashed with one more coordinate, which fills their length up to the
largest of all, and queries with that coordinate 0; angles then order as inner products do.

Equal vectors are one entry, with the ``k`` + 1 smallest ids that have it: no other can be among the ``k`` nearest.
Shards with many entries or many queries are cut on both sides, and each cell of a cut shard is one group, so a task
holds ``ENTRY_ROWS`` entries and ``QUERY_ROWS`` queries at most.  Nothing is left out by a cut.

Vectors that are null, empty, zero, or hold a null, infinite or undefined component take no part, nor do rows with a
null id.  Vectors of different lengths do not meet.  Rows that repeat an id are one object with several vectors: the
nearness of two objects is that of their nearest vectors, and no object is its own neighbour.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.memory import lean
from lodestone.runtime import Scratch

K = 20
TREES = 24
SYMBOLS = 8
SYMBOL_DIMS = 16
SYMBOL_BITS = 5
#: Candidates of a query, with repetitions: WANTED_FACTOR * n ** WANTED_POWER.  Set for a recall of 0.9 on vectors
#: without any structure, the worst case; figures are in the README.
WANTED_FACTOR = 1.62
WANTED_POWER = 0.9
ENTRY_ROWS = 1 << 15
QUERY_ROWS = 1 << 13
SCORES_AT_ONCE = 1 << 21

CELL = ["tree", "dims", "shard", "block", "turn"]
ASKED = ["h1", "h2"]


def wanted(n: int) -> int:
    return int(np.ceil(WANTED_FACTOR * n**WANTED_POWER))


@lru_cache(maxsize=4)
def _axes(dims: int, trees: int, seed: int) -> np.ndarray:
    """(dims, trees * SYMBOLS * SYMBOL_DIMS): the axes of each symbol are part of one rotation where there is room."""
    rng = np.random.default_rng([seed, dims])
    need, parts = trees * SYMBOLS * SYMBOL_DIMS, []
    while need > 0:
        turn = np.linalg.qr(rng.standard_normal((max(dims, SYMBOL_DIMS), max(dims, SYMBOL_DIMS))))[0]
        parts.append(turn[:dims, : len(turn) // SYMBOL_DIMS * SYMBOL_DIMS])
        need -= parts[-1].shape[1]
    return np.concatenate(parts, axis=1)[:, : trees * SYMBOLS * SYMBOL_DIMS].astype(np.float32)


def strings(vectors: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(rows, trees): each vector's string in each tree, as a number of SYMBOLS * SYMBOL_BITS bits."""
    axes = _axes(vectors.shape[1], trees, seed)
    out = np.zeros((len(vectors), trees), dtype=np.int64)
    for lo in range(0, len(vectors), 1024):
        part = vectors[lo : lo + 1024].astype(np.float32) @ axes
        part = part.reshape(len(part), trees, SYMBOLS, SYMBOL_DIMS)
        axis = np.abs(part).argmax(axis=3)
        symbol = 2 * axis + (np.take_along_axis(part, axis[..., None], 3)[..., 0] < 0)
        for k in range(SYMBOLS):
            out[lo : lo + 1024] = (out[lo : lo + 1024] << SYMBOL_BITS) | symbol[:, :, k]
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _hash_rows(batches: Iterator[pa.RecordBatch], trees: int, longest: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Entries with their strings as candidates and, where they are asked for, as queries."""
    for batch in batches:
        sizes = batch.column("dims").to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == dims))
            x = _matrix(part.column("vector"), dims) / longest
            rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))
            keys = strings(np.column_stack([x, rest]), trees, seed)
            asks = part.column("asks").to_numpy(zero_copy_only=False)
            length = np.linalg.norm(x[asks], axis=1, keepdims=True)
            asked = np.zeros_like(keys)
            asked[asks] = strings(np.column_stack([x[asks] / length, np.zeros(int(asks.sum()))]), trees, seed)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1)), trees).cast(pa.list_(pa.int64())) for a in (keys, asked)]
            yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=[*part.schema.names, "keys", "asked"])


def _interval(keys: np.ndarray, asked: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted ``keys`` the first ``depth`` symbols are those asked for."""
    shift = SYMBOL_BITS * (SYMBOLS - depth)
    prefix = asked >> shift
    return np.searchsorted(keys, prefix << shift), np.searchsorted(keys, (prefix + 1) << shift)


def _count_cell(entries: pa.Table, queries: pa.Table, first: int) -> pa.Table:
    """How many entries of a cell share each number of symbols from ``first`` on with each query."""
    keys = np.sort(entries.column("key").to_numpy())
    asked = queries.column("key").to_numpy()
    counts = np.zeros((len(asked), SYMBOLS + 1 - first), dtype=np.int64)
    for depth in range(first, SYMBOLS + 1):
        lo, hi = _interval(keys, asked, depth)
        counts[:, depth - first] = hi - lo
    lists = pa.FixedSizeListArray.from_arrays(pa.array(counts.reshape(-1)), counts.shape[1]).cast(pa.list_(pa.int64()))
    return pa.table({"h1": queries.column("h1"), "h2": queries.column("h2"), "tree": queries.column("tree"), "counts": lists})


def _ascend(batches: Iterator[pa.RecordBatch], trees: int, first: int, wish: int) -> Iterator[pa.RecordBatch]:
    """The depth to which each query ascends in each tree; ``enough`` unless more symbols have to go."""
    width = SYMBOLS + 1 - first
    for batch in batches:
        counts = np.zeros((batch.num_rows, trees, width), dtype=np.int64)
        for i, found in enumerate(batch.column("found").to_pylist()):
            for x in found:
                counts[i, x["tree"]] += x["counts"]
        more = counts.copy()  # what a depth adds to the one below it
        more[:, :, :-1] -= counts[:, :, 1:]
        order = more[:, :, ::-1].transpose(0, 2, 1).reshape(len(counts), -1)  # deepest first, tree by tree
        total = np.cumsum(order, axis=1)
        enough = total[:, -1] >= wish
        last = np.where(enough, (total >= wish).argmax(axis=1), order.shape[1] - 1)
        depth = (SYMBOLS - last // trees)[:, None] + (np.arange(trees)[None, :] > (last % trees)[:, None])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(depth.reshape(-1).astype(np.int64)), trees).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), lists, pa.array(enough | (first == 0))], names=["h1", "h2", "depths", "enough"])


def _best_ids(scores: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The k nearest ids, each once, nearest first."""
    best: dict[int, float] = {}
    for score, own in zip(scores.tolist(), ids, strict=True):
        for i in own:
            if score > best.get(i, -np.inf):
                best[i] = score
    return sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:k]


def _score_cell(entries: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest ids of each query among the entries of a cell that share its prefix."""
    out: dict[str, list] = {"h1": [], "h2": [], "vec_id": [], "score": []}
    if entries.num_rows and queries.num_rows:
        dims = queries.column("dims")[0].as_py()
        entries = entries.sort_by("key")
        keys, ids = entries.column("key").to_numpy(), entries.column("ids").combine_chunks()
        points, asked = _matrix(entries.column("vector"), dims), _matrix(queries.column("vector"), dims)
        reach = np.sqrt(np.einsum("ij,ij->i", points, points).max())
        names = list(zip(queries.column("h1").to_pylist(), queries.column("h2").to_pylist(), strict=True))
        depth, strings_asked = queries.column("depth").to_numpy(), queries.column("key").to_numpy()
        groups: dict[tuple[int, int], list[int]] = {}
        for d in np.unique(depth[depth <= SYMBOLS]).tolist():
            mine = np.flatnonzero(depth == d)
            for q, lo, hi in zip(mine.tolist(), *(x.tolist() for x in _interval(keys, strings_asked[mine], d)), strict=True):
                if hi > lo:
                    groups.setdefault((lo, hi), []).append(q)
        for (lo, hi), mine in groups.items():
            step = max(1, SCORES_AT_ONCE // (hi - lo))
            for at in range(0, len(mine), step):
                part = mine[at : at + step]
                rough = asked[part] @ points[lo:hi].T
                for q, row in zip(part, rough, strict=True):
                    # a matrix product may round equal sums differently: what could be among the best is summed up again
                    slack = 1e-12 * reach * float(np.sqrt(asked[q] @ asked[q]))
                    near = np.flatnonzero(row >= np.partition(row, -k)[-k] - slack) if len(row) > k else np.arange(len(row))
                    scores = (points[lo + near] * asked[q]).sum(axis=1)
                    for score, i in _best_ids(scores, ids.take(pa.array(lo + near)).to_pylist(), k):
                        out["h1"].append(names[q][0])
                        out["h2"].append(names[q][1])
                        out["vec_id"].append(i)
                        out["score"].append(score)
    return pa.table({"h1": pa.array(out["h1"], pa.int64()), "h2": pa.array(out["h2"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})


def _entries(rows: DataFrame, queries: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors with their k + 1 smallest ids, the ids that ask with their vector's hashes)."""
    sound = F.col("id").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda x: x != 0)
    sound = sound & F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    marked = rows.where(sound).select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"), queries.alias("asks"))
    asking = marked.where("asks").select("id", *ASKED).distinct()
    first = marked.groupBy("id", *ASKED).agg(F.any_value("vector").alias("vector"))
    rank = F.row_number().over(Window.partitionBy(*ASKED).orderBy("id"))
    ids = first.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    entries = ids.groupBy(*ASKED).agg(F.any_value("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = asking.select(*ASKED).distinct().withColumn("asks", F.lit(True))
    entries = entries.join(asked, ASKED, "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    return entries.withColumn("dims", F.size("vector").cast("long")), asking.toDF("query_id", *ASKED)


def _cells(rows: DataFrame, asked: DataFrame, first: int, entry_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """Entries and queries, a row for each tree and cell."""
    shift = SYMBOL_BITS * (SYMBOLS - first)
    shard = F.shiftright("key", shift) if first else F.lit(0).cast("long")
    place = ["tree", "dims", "shard"]
    each = rows.select("dims", "vector", "ids", F.posexplode("keys").alias("tree", "key")).withColumn("shard", shard)
    asks = asked.select("dims", "vector", *ASKED, *[c for c in asked.columns if c == "depths"], F.posexplode("asked").alias("tree", "key")).withColumn("shard", shard)
    if "depths" in asked.columns:
        asks = asks.withColumn("depth", F.expr("depths[tree]")).drop("depths")
    # groups of a shard, dealt on both sides: no more rows a cell than a task should hold
    size = lambda df, n: df.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / n).alias("cut"))
    cuts = size(each, entry_rows).withColumnRenamed("cut", "blocks").join(size(asks, query_rows).withColumnRenamed("cut", "turns"), place)
    blocks, turns = (F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)) for c in ("blocks", "turns"))
    deal = lambda x, c: F.pmod(F.xxhash64(*x), F.col(c))
    each = each.join(cuts, place).withColumn("block", deal(["ids"], "blocks")).withColumn("turn", turns).drop("blocks", "turns")
    asks = asks.join(cuts, place).withColumn("turn", deal(ASKED, "turns")).withColumn("block", blocks).drop("blocks", "turns")
    named = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731  both come from one table
    return named(each), named(asks)


def _counting(first: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda entries, queries: _count_cell(entries, queries, first)


def _ascending(trees: int, first: int, wish: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lean(lambda batches: _ascend(batches, trees, first, wish))


def nearest(
    rows: DataFrame, queries: Column, k: int = K, trees: int = TREES, vec_id: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None,
    wish: int | None = None, entry_rows: int = ENTRY_ROWS, query_rows: int = QUERY_ROWS, seed: int = 7,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each object of ``rows`` for which ``queries`` holds.

    ``queries`` is a condition on the columns of ``rows``; ``wish`` overrides the number of candidates.
    """
    scratch = scratch or Scratch(rows.sparkSession, "forest")
    entries, asking = _entries(rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), queries.alias("_q")), F.coalesce("_q", F.lit(False)), k)
    entries = scratch.table(entries, "entries")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, longest = entries.agg(F.count(F.lit(1)), F.sqrt(F.max(square))).first()
    # each tree meets the query itself too, and the rest are k others at least, should all trees meet the same
    wish = max(wanted(n) if wish is None else wish, trees * k) + trees
    kind = entries.schema["vector"].dataType.simpleString()
    schema = f"h1 long, h2 long, vector {kind}, ids array<long>, asks boolean, dims long, keys array<long>, asked array<long>"
    # the strings and the vectors are all that rounds read
    hashed = scratch.table(entries.mapInArrow(lean(lambda it: _hash_rows(it, trees, longest or 1.0, seed)), schema), "strings")
    first = 0
    while first < SYMBOLS and trees * n / (1 << SYMBOL_BITS * (first + 1)) >= wish:
        first += 1
    open_queries = hashed.where("asks").select("dims", "vector", *ASKED, "asked")
    found = None
    while True:
        each, asks = _cells(hashed.select("dims", F.lit(None).cast(kind).alias("vector"), "keys", "ids"), open_queries, first, entry_rows, query_rows)
        counts = each.select(*CELL, "key").groupBy(*CELL).cogroup(asks.select(*CELL, "key", *ASKED).groupBy(*CELL))
        counts = counts.applyInArrow(_counting(first), "h1 long, h2 long, tree int, counts array<long>")
        seen = open_queries.select(*ASKED).join(counts, ASKED, "left").groupBy(*ASKED).agg(F.collect_list(F.when(F.col("tree").isNotNull(), F.struct("tree", "counts"))).alias("found"))
        depths = seen.mapInArrow(_ascending(trees, first, wish), "h1 long, h2 long, depths array<long>, enough boolean")
        depths = scratch.table(depths, f"depths-{first}")
        done = open_queries.join(depths.where("enough").select(*ASKED, "depths"), ASKED)
        each, asks = _cells(hashed.select("dims", "vector", "keys", "ids"), done, first, entry_rows, query_rows)
        scored = each.select(*CELL, "key", "vector", "ids").groupBy(*CELL).cogroup(asks.select(*CELL, "key", "vector", "depth", *ASKED).groupBy(*CELL))
        scored = scored.applyInArrow(lambda a, b: _score_cell(a, b, k + 1), "h1 long, h2 long, vec_id long, score double")
        found = scored if found is None else found.union(scored)
        if first == 0:
            break
        left = depths.where("not enough").select(*ASKED)
        if left.isEmpty():
            break
        open_queries, first = open_queries.join(left, ASKED, "left_semi"), first - 1
    best = found.groupBy(*ASKED, "vec_id").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("vec_id")]
    best = best.withColumn("place", F.row_number().over(Window.partitionBy(*ASKED).orderBy(*order))).where(F.col("place") <= k + 1).drop("place")
    best = scratch.table(best, "best")
    own = asking.join(best, ASKED).where("query_id <> vec_id")
    own = own.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
