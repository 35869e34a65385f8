"""Change detection by content hash, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.imports import extract_imports
from lodestone.operators.resolve import edges as resolve_edges
from lodestone.operators.resolve import edges_to, known_targets, tried_paths, woken_importers
from lodestone.runtime import Scratch, by_rows


def manifest_of(files: DataFrame) -> DataFrame:
    return files.select("relative_path", "content_hash")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(relative_path, change) with change in added, updated, deleted, unchanged; both are manifests."""
    a = old.select("relative_path", F.col("content_hash").alias("old_hash"), F.lit(True).alias("was"))
    b = new.select("relative_path", F.col("content_hash").alias("new_hash"), F.lit(True).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("updated")
    return a.join(b, "relative_path", "full_outer").select("relative_path", change.alias("change"))


def counters(changes: DataFrame) -> DataFrame:
    """One row: total (present now), added, updated, deleted, needs_embedding."""
    of = {k: F.count_if(F.col("change") == k) for k in ("added", "updated", "deleted", "unchanged")}
    return changes.agg(
        (of["added"] + of["updated"] + of["unchanged"]).alias("total_files"), of["added"].alias("added"), of["updated"].alias("updated"),
        of["deleted"].alias("deleted"), (of["added"] + of["updated"]).alias("needs_embedding"),
    )


def replace_rows(old: DataFrame, new: DataFrame, changes: DataFrame, key: str = "relative_path") -> DataFrame:
    """A derived table after a change: rows of changed and deleted files go, new ones come."""
    stale = changes.where("change <> 'unchanged'").select(F.col("relative_path").alias(key))
    return old.join(by_rows(stale), key, "left_anti").select(new.columns).unionByName(new)


def changed_files(files: DataFrame, changes: DataFrame) -> DataFrame:
    return files.join(by_rows(changes.where("change in ('added', 'updated')").select("relative_path")), "relative_path", "left_semi")


def refresh_edges(manifest: DataFrame, imports: DataFrame, tries: DataFrame, new_manifest: DataFrame, parsed: DataFrame, changes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(edges, woken) after a change: the edges of changed files and of woken importers, and who was woken.

    ``manifest``, ``imports`` and ``tries`` (candidate, relative_path) are as before the change, ``new_manifest`` and
    ``parsed`` of the files that were added or updated.  All other edges stay as they are.
    """
    touched = changes.where("change <> 'unchanged'").select("relative_path")
    woken = scratch.table(woken_importers(tries, changes).join(by_rows(touched), "relative_path", "left_anti"), "woken")
    again = imports.join(by_rows(woken), "relative_path", "left_semi").select(parsed.columns).unionByName(parsed)
    asked = scratch.table(again, "asked-imports")
    # of all files only those that these imports try take part
    known = known_targets(replace_rows(manifest, new_manifest, changes))
    names = scratch.table(tried_paths(asked).select("candidate").distinct(), "asked-names")
    known = scratch.table(known.join(by_rows(names), "candidate", "left_semi"), "known")
    return edges_to(by_rows(known), by_rows(asked)), woken


def refresh_imports(imports: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """Only changed files are parsed again."""
    return replace_rows(imports, extract_imports(changed_files(files, changes)), changes)


def refresh_graph(imports: DataFrame, files: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(imports, edges) after a change.  Every import is resolved against all files of now, so imports of files
    that appeared since resolve, and none points at a deleted one."""
    fresh = refresh_imports(imports, files, changes)
    return fresh, resolve_edges(files, fresh)
