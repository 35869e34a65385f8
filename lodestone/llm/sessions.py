"""Session versions of events that arrive late, as components of a gap-edge graph for each snapshot.

After each batch the events of a user that have arrived so far form sessions: neighbours in time at most ``gap``
apart share one.  A session that holds an event of the batch is a new version, and the standing sessions that it
contains are retracted by it.

Seconds of a user that have an event are the nodes of a graph, and active from their first batch on.  An edge joins
each node to the nearest active nodes before and after it at the batch of its birth, if they are within the gap; edges
born later only refine what is connected by then, so the graph of a snapshot is that of the edges born so far.
Components come from alternating large-star and small-star steps over all snapshots at once.

A graph for every snapshot would repeat a user's whole past in each.  So snapshots are taken ``fan_out`` at a time,
from wide ranges down to single ones: for each part of a range, what was connected before it becomes one node that
carries the session's count, sum and end, and only nodes that the part's events or edges name go on.  An edge or an
event then stands in at most ``fan_out`` graphs of a level, and levels are the logarithm of the number of batches.
In a single snapshot's graph the nodes that stand for sessions are those that its versions contain.

No step needs a user's events together: neighbours are sought in stretches of 16 gaps with their margins, one row a
second; all else are sums and joins, whose hot sides AQE can split.  Events with a null user, second or batch take
no part; a null weight counts as 0; repeated events count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.memory import lean
from lodestone.runtime import Scratch

GAP = 240
FAN_OUT = 16
BLOCK_GAPS = 16
MAX_ROUNDS = 60
FOREST_ROWS = 1 << 18

GRAPH = ["user", "part"]  # the columns that tell graphs apart
COLUMNS = ["user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s"]


def _floor_div(x: str, by: int) -> str:
    return f"({x} - pmod({x}, {by}L)) div {by}L"


def gap_edges(cells: DataFrame, gap: int = GAP) -> DataFrame:
    """(user, a, b, birth): a < b, one edge at most from each node to its nearest active neighbour on either side."""
    block = BLOCK_GAPS * gap
    nodes = cells.groupBy("user", "second").agg(F.min("batch").alias("birth"))
    near = F.array_distinct(F.array(*(F.expr(_floor_div(f"(second + {d}L)", block)) for d in (-gap, 0, gap))))
    spread = nodes.select("user", "second", "birth", F.explode(near).alias("block"))
    order = Window.partitionBy("user", "block").orderBy("second")
    seen = F.collect_list(F.struct("second", "birth"))
    sides = spread.withColumn("before", seen.over(order.rangeBetween(-gap, -1))).withColumn("after", seen.over(order.rangeBetween(1, gap)))
    own = sides.where(f"block = {_floor_div('second', block)}")
    # of two born together, the later one makes the edge
    before = F.expr("array_max(transform(filter(before, x -> x.birth <= birth), x -> x.second))")
    after = F.expr("array_min(transform(filter(after, x -> x.birth < birth), x -> x.second))")
    both = F.array(F.struct(before.alias("a"), F.col("second").alias("b")), F.struct(F.col("second").alias("a"), after.alias("b")))
    return own.select("user", "birth", F.explode(both).alias("e")).where("e.a is not null and e.b is not null").select("user", "e.a", "e.b", "birth")


def _stretches(batches: Iterator[pa.RecordBatch], rows: int = FOREST_ROWS) -> Iterator[list[np.ndarray]]:
    """The columns of some batches together, so many rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in range(4)]
            held, n = [], 0
    if n:
        yield [np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in range(4)]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a stretch as stars: each node to the least one that it is connected with inside the stretch."""
    for user, part, a, b in _stretches(batches):
        _, graph = np.unique(np.stack([user, part], axis=1), axis=0, return_inverse=True)
        graph = graph.reshape(-1)
        ends = np.stack([np.concatenate([graph, graph]), np.concatenate([a, b])], axis=1)
        nodes, at = np.unique(ends, axis=0, return_inverse=True)
        x, y = at.reshape(-1)[: len(a)], at.reshape(-1)[len(a) :]
        least = np.arange(len(nodes))
        while True:
            low = np.minimum(least[x], least[y])
            new = least.copy()
            np.minimum.at(new, least[x], low)
            np.minimum.at(new, least[y], low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, least):
                break
            least = new
        other = np.flatnonzero(least != np.arange(len(nodes)))
        first = np.unique(graph, return_index=True)[1][nodes[other, 0]]
        columns = [user[first], part[first], nodes[other, 1], nodes[least[other], 1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["user", "part", "a", "b"])


def star_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(user, part, node, label) for every node but the least of each component of links (user, part, a, b)."""
    links = links.where("a <> b").select(*GRAPH, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = scratch.table(links.mapInArrow(lean(_forest), "user long, part long, a long, b long"), f"{name}-0")
    settled: list[DataFrame] = []
    for k in range(1, MAX_ROUNDS):
        # settled: every node points at one other, which points at none
        ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("up")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("up")))
        seen = edges.select(*GRAPH, F.explode(ends).alias("e")).groupBy(*GRAPH, "e.node")
        open_ends = seen.agg(F.min("e.up").alias("low"), F.max("e.up").alias("high"), F.bool_or(F.expr("e.up is null")).alias("root"))
        unsettled = scratch.table(open_ends.where("low <> high or (low is not null and root)").select(*GRAPH).distinct(), f"{name}-open-{k}")
        if unsettled.isEmpty():
            break
        settled.append(edges.join(unsettled, GRAPH, "left_anti"))
        edges = edges.join(unsettled, GRAPH, "left_semi")
        both = edges.union(edges.select(*GRAPH, "b", "a")).toDF(*GRAPH, "node", "near")
        least = both.groupBy(*GRAPH, "node").agg(F.least(F.min("near"), F.first("node")).alias("least"))
        large = both.join(least, [*GRAPH, "node"]).where("near > node").select(*GRAPH, F.col("near").alias("a"), F.col("least").alias("b")).where("a <> b")
        low = large.groupBy(*GRAPH, "a").agg(F.min("b").alias("least"))
        small = large.join(low, [*GRAPH, "a"])
        stars = F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct(F.col("a").alias("a"), F.col("least").alias("b")))
        new = small.select(*GRAPH, F.explode(stars).alias("e")).select(*GRAPH, "e.a", "e.b").where("a <> b").distinct()
        edges = scratch.table(new, f"{name}-{k}")
    else:
        raise RuntimeError("components did not settle")
    return reduce(DataFrame.union, settled, edges).distinct().toDF(*GRAPH, "node", "label")


def _relabelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    named = labels.withColumnsRenamed({"node": column, "label": "_label"})
    return rows.join(named, [*GRAPH, column], "left").withColumn(column, F.coalesce("_label", column)).drop("_label")


def _divide(touches: DataFrame, edges: DataFrame, standing: DataFrame, width: int, fan_out: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The state of each part of ``width`` batches, from that of ranges of ``fan_out`` parts."""
    part_of = lambda column: F.expr(f"{column} div {width}L")  # noqa: E731  batches count from 0
    held = lambda df: df.withColumnRenamed("part", "range")
    kids = scratch.table(held(touches).select("user", "range", part_of("batch").alias("part")).distinct(), f"{name}-parts")
    # what was connected before a part began is one node of it
    earlier = held(edges).withColumn("own", part_of("birth")).join(kids, ["user", "range"]).where("own < part")
    labels = scratch.table(star_components(earlier.select(*GRAPH, "a", "b"), scratch, f"{name}-before"), f"{name}-labels")
    parts = held(touches).withColumn("part", part_of("batch")).drop("range")
    parts = scratch.table(_relabelled(parts, labels, "id"), f"{name}-touches")
    links = held(edges).withColumn("part", part_of("birth")).drop("range")
    links = scratch.table(_relabelled(_relabelled(links, labels, "a"), labels, "b"), f"{name}-edges")
    named = F.explode(F.array("a", "b"))
    refs = parts.select(*GRAPH, "id").union(links.select(*GRAPH, named)).distinct()
    old = held(standing).join(kids, ["user", "range"]).select(*GRAPH, "id", "n", "h", "end_s")
    came = held(touches).groupBy("user", "range", part_of("batch").alias("own"), "id").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("second").alias("end_s"))
    came = came.join(kids, ["user", "range"]).where("own < part").select(*GRAPH, "id", "n", "h", "end_s")
    sums = _relabelled(old.union(came), labels, "id").groupBy(*GRAPH, "id").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("end_s").alias("end_s"))
    return parts, links, scratch.table(sums.join(refs, [*GRAPH, "id"], "left_semi"), f"{name}-standing")


def session_versions(events: DataFrame, scratch: Scratch | None = None, gap: int = GAP, fan_out: int = FAN_OUT) -> DataFrame:
    """Every version of every session of ``events`` (user, second, batch, h: long).

    user, batch, start_s, end_s, n_events, n_new (of that batch), n_retracted, h_sum (over all n_events), and batch
    and start of the version that retracts it, null for those that stand in the end.
    """
    if fan_out < 2 or gap < 1:
        raise ValueError("fan_out is at least 2 and gap at least 1")
    spark = events.sparkSession
    scratch = scratch or Scratch(spark, "sessions")
    known = events.where("user is not null and second is not null and batch is not null")
    cells = known.groupBy("user", "second", "batch").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("long").alias("h"))
    cells = scratch.table(cells, "cells")
    low, high = cells.agg(F.min("batch"), F.max("batch")).first()
    if low is None:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in COLUMNS))
    width = fan_out
    while width <= high - low:
        width *= fan_out
    counted = cells.withColumn("batch", F.col("batch") - low)
    zero = F.lit(0).cast("long").alias("part")
    edges = scratch.table(gap_edges(counted, gap).select("user", zero, "a", "b", "birth"), "edges")
    touches = counted.select("user", zero, F.col("second").alias("id"), "second", "batch", "n", "h")
    standing = spark.createDataFrame([], "user long, part long, id long, n long, h long, end_s long")
    while width > 1:
        width //= fan_out
        touches, edges, standing = _divide(touches, edges, standing, width, fan_out, scratch, f"parts-{width}")
    # now a part is a batch, its edges are those born with it, and what stands are the sessions before it
    labels = scratch.table(star_components(edges.select(*GRAPH, "a", "b"), scratch, "versions"), "labels")
    nothing = F.lit(0).cast("long")
    new = touches.select(*GRAPH, "id", F.col("second").alias("end_s"), "n", "h", F.col("n").alias("n_new"), nothing.alias("old"))
    old = standing.select(*GRAPH, "id", "end_s", "n", "h", nothing.alias("n_new"), F.lit(1).cast("long").alias("old"))
    members = scratch.table(_relabelled(new.union(old).withColumn("node", F.col("id")), labels, "id").withColumnRenamed("id", "start_s"), "members")
    sums = [F.max("end_s").alias("end_s"), F.sum("n").alias("n_events"), F.sum("n_new").alias("n_new"), F.sum("old").alias("n_retracted"), F.sum("h").alias("h_sum")]
    versions = members.groupBy(*GRAPH, "start_s").agg(*sums)
    # the next graph in which a session's start stands for it is that of the version that contains it
    kept = [F.col(c) for c in ("end_s", "n_events", "n_new", "n_retracted", "h_sum")]
    none = [F.lit(None).cast("long").alias(c) for c in ("end_s", "n_events", "n_new", "n_retracted", "h_sum")]
    rows = versions.select("user", F.col("start_s").alias("node"), "part", F.lit(1).alias("made"), *kept, "start_s")
    rows = rows.union(members.where("old = 1").select("user", "node", "part", F.lit(0).alias("made"), *none, "start_s"))
    order = Window.partitionBy("user", "node").orderBy("part", "made")
    linked = rows.withColumn("next", F.lead(F.struct("part", "start_s")).over(order)).where("made = 1")
    return linked.select(
        "user", (F.col("part") + low).alias("batch"), "start_s", *kept,
        (F.col("next.part") + low).alias("retracted_batch"), F.col("next.start_s").alias("retracted_start_s"),
    ).select(*COLUMNS)
