"""Connected components of a link table, without collecting links.

Alternating star contractions: every node is pointed at the least neighbour it sees, until the links
are stars around each component's least node.  Before each round, each partition replaces its links by
a spanning forest of them, which keeps what connects and drops the rest.  A node with very many links is
aggregated before the shuffle, and meets its links in a join that AQE can split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.memory import lean
from lodestone.runtime import Scratch

MAX_ROUNDS = 60
Accept = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class UnionFind:
    """Sets of nodes named by their least member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, a: int) -> int:
        parent = self.parent
        root = a
        while (up := parent.get(root, root)) != root:
            root = up
        while a != root:
            parent[a], a = root, parent.get(a, a)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star links of the components within a partition; memory follows its distinct nodes."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
    nodes = [n for n in sets.parent if sets.find(n) != n]
    for lo in range(0, len(nodes), 1 << 16) or [0]:
        part = nodes[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([sets.find(n) for n in part], pa.int64())], names=["a", "b"])


def connected_components(links: DataFrame, scratch: Scratch, label: str = "components", accept: Accept | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (two long columns); component is the least node.

    Links with a null end, and links from a node to itself, connect nothing.  With ``accept``, which turns
    batches of ``links`` (with whatever columns it needs) into those of the links that hold, nothing is left
    out before it; it runs in the same worker as the first forest.
    """
    a, b = links.columns[:2]
    if accept is None:
        pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
        first = pairs.mapInArrow(lean(_forest), "a long, b long")
    else:
        first = links.mapInArrow(lean(lambda it: _forest(accept(it))), "a long, b long")
    edges = scratch.table(first, f"{label}-0")
    for k in range(1, MAX_ROUNDS):
        # large star: neighbours above a node go to the least node around it
        both = edges.union(edges.select("b", "a")).toDF("node", "near")
        least = both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("least"))
        large = both.join(least, "node").where("near > node").select(F.col("near").alias("a"), F.col("least").alias("b"))
        # small star: a node and its lower neighbours go to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "least", "a")
        stars = small.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("least").alias("b")), F.struct(F.col("a").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*")
        new = scratch.table(stars.where("a != b").distinct().mapInArrow(lean(_forest), "a long, b long"), f"{label}-{k}")
        # done when no target has a target of its own
        done = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        scratch.drop(f"{label}-{k - 1}")
        edges = new
        if done and edges.groupBy("a").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("a"), "b").distinct()
    return scratch.table(edges.union(roots).toDF("node", "component"), label)
