"""Results as text, for people and tools; small results only."""

from __future__ import annotations

from pyspark.sql import DataFrame


def render_search(hits: DataFrame, hybrid: bool = False, pending: int = 0) -> str:
    """A numbered list: score, path, and the excerpt set in by four spaces."""
    rows = hits.collect()  # at most the search limit
    ranking = "words and vectors" if hybrid else "words"
    if not rows:
        return f"nothing found (ranked by {ranking})"
    out = [f"{len(rows)} found, ranked by {ranking}, scores from {rows[0].score:.4f} down to {rows[-1].score:.4f}"]
    if pending:
        out[0] += f"; {pending} changes are not in yet"
    for k, r in enumerate(rows, 1):
        out.append(f"{k:>3}. {r.score:.4f} {r.path}")
        out += [f"    {line}" for line in r.snippet.split("\n")]
    return "\n".join(out)


def _listed(head: str, items: list[str]) -> str:
    return "\n".join([f"{head}: {len(items)}", *(f"  {x}" for x in items)])


def render_graph(operation: str, result: DataFrame, file: str | None = None) -> str:
    """A count under a heading, then a line for each row."""
    if operation == "deps":
        return _listed(f"files that {file} imports", [r.dst for r in result.toLocalIterator()])
    if operation == "dependents":
        return _listed(f"files that import {file}", [r.src for r in result.toLocalIterator()])
    if operation == "cycles":
        return _listed("import cycles", [" > ".join([*r.cycle, r.cycle[0]]) for r in result.orderBy("cycle").toLocalIterator()])
    if operation == "components":
        return _listed("files in import circles, after the first file of their circle", [f"{r.component}: {r.node}" for r in result.orderBy("component", "node").toLocalIterator()])
    if operation == "path":
        return _listed("files on the shortest way", [r.node for r in result.toLocalIterator()])
    rows = [(r.depth, r.path) for r in result.orderBy("depth", "path").toLocalIterator()]
    return _listed(f"files that a change of {file} can reach, with their distance", [f"{depth} {path}" for depth, path in rows])


def render_status(row: DataFrame) -> str:
    values = row.first().asDict()
    width = max(map(len, values))
    return "\n".join(f"{k.ljust(width)}  {v}" for k, v in values.items())
