"""Components and cycles of graphs against plain searches."""

import random

from lodestone.operators import graph


def reach_of(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    seen = {}
    for start in out:
        work, got = [start], set()
        while work:
            for n in out[work.pop()]:
                if n not in got:
                    got.add(n)
                    work.append(n)
        seen[start] = got
    return seen


def plain_components(edges):
    seen = reach_of([(a, b) for a, b in edges if a != b])
    return {n: min(m for m in seen if m in seen[n] and n in seen[m]) for n in seen if n in seen[n]}


def plain_cycles(edges):
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
    found = []

    def grow(trail):
        for n in sorted(out.get(trail[-1], ())):
            if n == trail[0] and len(trail) > 1:
                found.append(list(trail))
            elif n > trail[0] and n not in trail:
                grow([*trail, n])

    for n in sorted(out):
        grow([n])
    return sorted(found)


def test_components_and_cycles_of_random_graphs(spark):
    """Many small graphs in one table, each with names of its own."""
    rng = random.Random(3)
    rows = []
    for g in range(40):
        n = rng.randrange(2, 9)
        rows += [(g * 100 + rng.randrange(n), g * 100 + rng.randrange(n)) for _ in range(rng.randrange(1, 2 * n))]
    rows += [(4000 + k, 4000 + (k + 1) % 12) for k in range(12)] + [(4003, 4100), (4100, 4101), (4101, 4100), (4100, 4000 + 200)]
    df = spark.createDataFrame(rows + rows[:20], "src long, dst long")
    assert {r.node: r.component for r in graph.components(df).collect()} == plain_components(rows)
    assert sorted(r.cycle for r in graph.cycles(df).collect()) == plain_cycles(rows)
    assert sorted(r.cycle for r in graph.cycles(df, 4).collect()) == [c for c in plain_cycles(rows) if len(c) <= 4]


def test_dense_component_ends(spark):
    """30 nodes that all point at one another have more cycles than can be listed: the component is told, and one cycle."""
    rows = [(f"n{a:02}", f"n{b:02}") for a in range(30) for b in range(30) if a != b] + [("n07", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("y", "w")]
    df = spark.createDataFrame(rows, "src string, dst string")
    parts = {r.node: r.component for r in graph.components(df).collect()}
    assert parts == {**{f"n{k:02}": "n00" for k in range(30)}, **dict.fromkeys("xyz", "x")}
    assert sorted(r.cycle for r in graph.cycles(df).collect()) == [["n00", "n01"], ["x", "y", "z"]]
    from lodestone.runtime import Scratch

    summary = graph.component_summary(graph.cyclic_edges(df, Scratch(spark, "dense")))
    assert {tuple(r) for r in summary.collect()} == {("n00", 30, 870, False), ("x", 3, 3, True)}


def test_graphs_without_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "src int, dst int")
    assert graph.components(df).collect() == [] and graph.cycles(df).collect() == []
    assert graph.components(df.limit(0)).collect() == []
