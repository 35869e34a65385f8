"""Queries over an edge table (src, dst).

Traversals run a join a level; each level is written to the shared folder, so lineage stays short and a
lost executor costs one level at most.  Nodes may be of any ordered type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.analyze import rotate_cycle
from lodestone.runtime import Scratch

MAX_DEPTH = 10
#: All cycles of a component are listed if it has at most so many edges beyond a spanning tree.
LISTED_RANK = 12


def deps(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("src") == node).select("dst").distinct().orderBy("dst")


def dependents(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("dst") == node).select("src").distinct().orderBy("src")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def stats(edges: DataFrame) -> DataFrame:
    """One row: edges, and nodes that have one."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return edges.agg(F.count(F.lit(1)).alias("n_edges")).crossJoin(nodes.agg(F.count(F.lit(1)).alias("n_nodes")))  # a row each


def remove_file(edges: DataFrame, node) -> DataFrame:
    return edges.where((F.col("src") != node) & (F.col("dst") != node))


def impact(edges: DataFrame, node, max_depth: int = MAX_DEPTH, scratch: Scratch | None = None) -> DataFrame:
    """(path, depth) of everything that depends on a node, at its least distance, up to ``max_depth``."""
    scratch = scratch or Scratch(edges.sparkSession, "impact")
    kind = edges.schema["src"].dataType
    back = edges.select("src", "dst")
    frontier = edges.sparkSession.range(1).select(F.lit(node).cast(kind).alias("path"), F.lit(0).alias("depth"))
    visited = frontier
    for depth in range(1, max_depth + 1):
        step = back.join(frontier.select(F.col("path").alias("dst")), "dst").select(F.col("src").alias("path")).distinct()
        frontier = scratch.table(step.join(visited.select("path"), "path", "left_anti").withColumn("depth", F.lit(depth)), f"level-{depth}")
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return visited.where("depth > 0")


def impact_totals(layers: DataFrame) -> DataFrame:
    """total, direct and indirect counts."""
    return layers.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("depth") == 1).alias("direct")).withColumn("indirect", F.col("total") - F.col("direct"))


def shortest_path(edges: DataFrame, start, end, max_depth: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(step, node) rows of the least of the shortest paths; no row without a path.  A node's path to itself is itself.

    The search ends with the frontier; ``max_depth`` ends it earlier.  What was visited is kept as one table.
    """
    scratch = scratch or Scratch(edges.sparkSession, "path")
    kind = edges.schema["src"].dataType
    frontier = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.array(F.lit(start).cast(kind)).alias("trail"))
    visited = frontier.select("node")
    found, depth = frontier.where(F.col("node") == end), 0
    while found.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        step = edges.join(frontier, edges.src == frontier.node).select(F.col("dst").alias("node"), F.concat("trail", F.array("dst")).alias("trail"))
        frontier = scratch.table(step.groupBy("node").agg(F.min("trail").alias("trail")).join(visited, "node", "left_anti"), f"level-{depth}")
        if frontier.isEmpty():
            break
        found = frontier.where(F.col("node") == end)
        visited = visited.union(frontier.select("node"))
        if depth % 8 == 0:  # else the plan grows with the depth
            visited = scratch.table(visited, f"visited-{depth}")
    return found.select(F.posexplode("trail").alias("step", "node")).orderBy("step")


def cyclic_core(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct edges, most of those that no cycle can hold left out: ends without a way in or a way on are peeled
    off while that takes a tenth of the edges."""
    e, turn = scratch.table(edges.where("src <> dst").select("src", "dst").distinct(), "core-0"), 0
    many = e.count()
    while many:
        turn += 1
        left = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        e = scratch.table(left.select("src", "dst"), f"core-{turn}")
        scratch.drop(f"core-{turn - 1}")
        now = e.count()
        if now > 0.9 * many:
            break
        many = now
    return e


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node on a cycle: nodes that reach one another share a component, named by its least node.

    Each round colours every node with the least node that reaches it; a node that keeps its own name is the root of
    the component of those of its colour that reach it back.  These are told, and rounds go on with the edges that are
    left within a colour.  A step is a join of the nodes that changed with their edges.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    e, found, turn = cyclic_core(edges, scratch), [], 0
    while not e.isEmpty():
        turn += 1
        nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = scratch.table(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("fresh")), f"colour-{turn}-0")
        step = 0
        while not colours.where("fresh").isEmpty():
            step += 1
            told = colours.where("fresh").select(F.col("node").alias("src"), "colour").join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("told"))
            colours = colours.join(told, "node", "left").select("node", F.least("colour", "told").alias("colour"), F.coalesce(F.col("told") < F.col("colour"), F.lit(False)).alias("fresh"))
            colours = scratch.table(colours, f"colour-{turn}-{step}")
            scratch.drop(f"colour-{turn}-{step - 1}")
        named = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        within = e.join(named("src"), "src").join(named("dst"), "dst").where("src_colour = dst_colour").select("src", "dst")
        within = scratch.table(within, f"within-{turn}")
        state = scratch.table(colours.select("node", "colour", (F.col("node") == F.col("colour")).alias("back"), (F.col("node") == F.col("colour")).alias("fresh")), f"back-{turn}-0")
        step = 0
        while not state.where("fresh").isEmpty():
            step += 1
            told = state.where("fresh").select(F.col("node").alias("dst")).join(within, "dst").select(F.col("src").alias("node"), F.lit(True).alias("told")).distinct()
            state = state.join(told, "node", "left").select("node", "colour", (F.col("back") | F.col("told").isNotNull()).alias("back"), (~F.col("back") & F.col("told").isNotNull()).alias("fresh"))
            state = scratch.table(state, f"back-{turn}-{step}")
            scratch.drop(f"back-{turn}-{step - 1}")
        found.append(state.where("back").select("node", F.col("colour").alias("component")))
        rest = state.where("not back").select("node")
        left = within.join(rest.withColumnRenamed("node", "src"), "src", "left_semi").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
        e = cyclic_core(left, Scratch(edges.sparkSession, f"components-{turn}"))
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    all_of = scratch.table(reduce(DataFrame.union, found), "components")
    several = all_of.groupBy("component").count().where("count > 1").select("component")
    return all_of.join(several, "component", "left_semi").select("node", "component")


def cyclic_edges(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(component, src, dst): the distinct edges that lie on a cycle."""
    parts = components(edges, scratch)
    ends = [parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")) for end in ("src", "dst")]
    inside = edges.where("src <> dst").select("src", "dst").distinct().join(ends[0], "src").join(ends[1], "dst").where("src_part = dst_part")
    return scratch.table(inside.select(F.col("src_part").alias("component"), "src", "dst"), "cyclic-edges")


def component_summary(cyclic: DataFrame) -> DataFrame:
    """component, n_nodes, n_edges, and whether all its cycles are listed: a component has at most 2 ** (edges - nodes
    + 1) elementary cycles."""
    ends = cyclic.select("component", F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = ends.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    counted = cyclic.groupBy("component").agg(F.count(F.lit(1)).alias("n_edges")).join(nodes, "component")
    return counted.select("component", "n_nodes", "n_edges", (F.col("n_edges") - F.col("n_nodes") + 1 <= LISTED_RANK).alias("listed"))


def shortest_through_roots(cyclic: DataFrame, scratch: Scratch) -> DataFrame:
    """cycle: of each component, the least of the shortest cycles through its least node."""
    e = cyclic.select("component", "src", "dst")
    frontier = e.select("component").distinct().select("component", F.col("component").alias("node"), F.array("component").alias("trail"))
    visited, found, depth = frontier.select("component", "node"), [], 0
    while not frontier.isEmpty():
        depth += 1
        step = e.join(frontier.withColumnRenamed("node", "src"), ["component", "src"]).select("component", F.col("dst").alias("node"), "trail")
        step = scratch.table(step.groupBy("component", "node").agg(F.min("trail").alias("trail")), f"around-{depth}")
        closed = step.where("node = component").select("component", "trail")
        found.append(closed)
        open_ones = step.join(closed.select("component"), "component", "left_anti").join(visited, ["component", "node"], "left_anti")
        frontier = scratch.table(open_ones.select("component", "node", F.concat("trail", F.array("node")).alias("trail")), f"front-{depth}")
        visited = scratch.table(visited.union(frontier.select("component", "node")), f"visited-{depth}")
    return reduce(DataFrame.union, found).select(F.col("trail").alias("cycle")) if found else e.select(F.array("src").alias("cycle")).where("false")


def cycles(edges: DataFrame, max_length: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Elementary cycles, each once, from its least node on; ``max_length`` leaves out those of more nodes.

    Trails grow from their least node over larger ones inside a component, so each cycle has one trail.  With a
    ``max_length`` all cycles up to it are listed.  Without one, all cycles of components that can have
    2 ** ``LISTED_RANK`` at most are; a component that can have more is told by the shortest cycle through its least
    node, and :func:`component_summary` tells which those are and how large.
    """
    scratch = scratch or Scratch(edges.sparkSession, "cycles")
    if max_length is not None and max_length <= 3:  # the trails are few
        return _trails(scratch.table(edges.where("src <> dst").select("src", "dst").distinct(), "edges"), max_length, scratch)
    cyclic = cyclic_edges(edges, scratch)
    if max_length is not None:
        return _trails(cyclic.select("src", "dst"), max_length, scratch)
    listed = component_summary(cyclic).where("listed").select("component")
    many = scratch.table(cyclic.join(listed, "component", "left_anti").select("component", "src", "dst"), "many")
    few = scratch.table(cyclic.join(listed, "component", "left_semi").select("src", "dst"), "few")
    return _trails(few, None, scratch).union(shortest_through_roots(many, scratch))


def _trails(e: DataFrame, max_length: int | None, scratch: Scratch) -> DataFrame:
    trails = e.where("src < dst").select(F.col("src").alias("root"), F.col("dst").alias("last"), F.array("src", "dst").alias("trail"))
    closing = e.select(F.col("src").alias("last"), F.col("dst").alias("root"))
    found, length = [], 2
    while max_length is None or length <= max_length:
        if length > 2:
            grown = trails.join(e.select(F.col("src").alias("last"), F.col("dst").alias("next")), "last").where("next > root and not array_contains(trail, next)")
            trails = scratch.table(grown.select("root", F.col("next").alias("last"), F.concat("trail", F.array("next")).alias("trail")), f"length-{length}")
            if trails.isEmpty():
                break
        found.append(scratch.table(trails.join(closing, ["root", "last"]).select(rotate_cycle(F.col("trail")).alias("cycle")), f"found-{length}"))
        length += 1
    out = found[0] if found else closing.where("false").select(F.array("root", "last").alias("cycle"))
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()
