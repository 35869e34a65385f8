"""The engine: one object over a warehouse, with search, graph queries, status and maintenance.

Results are DataFrames; :mod:`lodestone.plans.render` turns them into text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import partial, reduce
from threading import Thread

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import analyze
from lodestone.operators import graph, incremental, search, vectors
from lodestone.operators.imports import extract_imports
from lodestone.operators.resolve import tried_paths
from lodestone.plans.query import Clause, Group, parse
from lodestone.runtime import Scratch, by_rows
from lodestone.sources.files import scan_in_rounds
from lodestone.sources.warehouse import SupersededError, Warehouse

OVERFETCH = 3
GRAPH_OPERATIONS = ("deps", "dependents", "cycles", "components", "path", "impact")


class Engine:
    """``provider`` makes an embedding provider; without one, the first of ``model_folders`` that holds a model does."""

    def __init__(self, spark: SparkSession, warehouse: str, root: str | None = None, provider: Callable[[], object] | None = None, model_folders: tuple[str, ...] = ()):
        self.spark, self.root = spark, root
        folder = None if provider else vectors.find_model(*model_folders)
        self.provider = provider or (partial(vectors.OnnxEncoder, folder) if folder else None)
        self.warehouse = Warehouse(spark, warehouse)
        #: The embedding job: its number, whether it runs, files to embed, files done, and what stopped it.
        self.progress: dict = {"generation": 0, "active": False, "total": 0, "done": 0, "error": None}
        self._job: Thread | None = None
        #: The streaming query that maintains the index, if one does; paths that wait for their burst to end, and
        #: when and in how many seconds the last burst was applied.
        self.watcher = None
        self.pending: dict = {"paths": 0, "last_update": None, "seconds": None}

    # --- Maintenance -------------------------------------------------------------------------------

    def ensure(self) -> None:
        """Scan and build if nothing is indexed yet."""
        if self.warehouse.state()["version"] == 0 and self.root:
            self.refresh()

    def refresh(self, files: DataFrame | None = None, background: bool = False) -> DataFrame:
        """Bring all tables up to date with the files (of the root, if none are given): a row of counters.

        The files are read once, into a table of their own, so one commit holds one state of the tree.  With
        ``background`` the embeddings follow in a job of their own.
        """
        scratch = Scratch(self.spark, "refresh")
        try:
            files = scratch.table(scan_in_rounds(self.spark, self.root, scratch) if files is None else files, "files")
            changes = incremental.diff(self.warehouse.read("manifest"), incremental.manifest_of(files))
            return self._apply(files, changes, scratch, background)
        finally:
            scratch.drop()

    def apply(self, changed: DataFrame, deleted: DataFrame, background: bool = False) -> DataFrame:
        """Upsert some files and delete some paths (relative_path): a row of counters."""
        scratch = Scratch(self.spark, "apply")
        try:
            deleted = scratch.table(deleted.select("relative_path").distinct(), "deleted")
            changed = scratch.table(changed.join(by_rows(deleted), "relative_path", "left_anti"), "changed")
            touched = changed.select("relative_path").union(deleted)
            before = self.warehouse.read("manifest").join(by_rows(touched), "relative_path", "left_semi")
            return self._apply(changed, incremental.diff(before, incremental.manifest_of(changed)), scratch, background)
        finally:
            scratch.drop()

    def _apply(self, files: DataFrame, changes: DataFrame, scratch: Scratch, background: bool) -> DataFrame:
        """Commit ``changes``; ``files`` has all that were added or updated.  Only those are read, parsed and written."""
        state = self.warehouse.state()
        changes = scratch.table(changes, "changes")
        counters = self.spark.createDataFrame(incremental.counters(changes).collect(), "total_files long, added long, updated long, deleted long, needs_embedding long")
        if state["version"] and changes.where("change <> 'unchanged'").isEmpty():
            return counters
        # both callers give a stored table; of a first build all of it is new
        fresh = scratch.table(incremental.changed_files(files, changes), "fresh") if state["version"] else files.where("relative_path is not null")
        stale = changes.where("change in ('updated', 'deleted')").select("relative_path")
        docs, manifest = search.search_documents(fresh), incremental.manifest_of(fresh)
        parsed = scratch.table(extract_imports(fresh), "imports")
        # edges are made of the changed files, and of those that try a path that came or went
        before = lambda name: self.warehouse.read(name, state)
        untold = bool(state["version"]) and "tries" not in state["tables"]  # written before that table was kept
        tries = tried_paths(before("imports")) if untold else before("tries")
        edges, woken = incremental.refresh_edges(before("manifest"), before("imports"), tries, manifest, parsed, changes, scratch)
        rows = {
            "files": fresh, "manifest": manifest, "postings": search.whole_postings(docs), "field_stats": search.field_stats(docs), "imports": parsed,
            "tries": incremental.replace_rows(tries, tried_paths(parsed), changes) if untold else tried_paths(parsed), "edges": edges,
        }
        self.warehouse.commit(state["version"], rows, stale, {"edges": woken})
        if self.provider:
            self.embed(background)
        return counters

    def embed(self, background: bool = False, slices: int = 4) -> None:
        """Embed the files that have no vectors, some at a time, each part a commit.

        A later call supersedes this one: its Spark jobs, which carry a tag of their own, are interrupted.
        """
        old = self.progress
        tag = f"embed-{uuid.uuid4().hex}"
        self.progress = {"generation": old["generation"] + 1, "active": True, "total": 0, "done": 0, "error": None, "tag": tag}
        if old["active"]:
            self.spark.sparkContext.cancelJobsWithTag(old["tag"])
        progress = self.progress
        if not background:
            self._embed(progress, 1)
            return

        def run() -> None:
            try:
                self._embed(progress, slices)
            except Exception as e:  # told by the status, as nobody waits for the job
                if progress is self.progress:
                    progress["error"] = f"{type(e).__name__}: {e}"[:500]

        self._job = Thread(target=run, daemon=True)
        self._job.start()

    def wait(self) -> None:
        """Until the background job has ended."""
        if self._job:
            self._job.join()

    def _embed(self, progress: dict, slices: int) -> None:
        scratch = Scratch(self.spark, "embed")
        tag = progress.get("tag")
        if tag:
            self.spark.sparkContext.addJobTag(tag)  # for the jobs of this thread
        try:
            read = self.warehouse.read
            missing = scratch.table(read("files").join(read("vectors").select("relative_path").distinct(), "relative_path", "left_anti"), "missing")
            progress["total"] = missing.count()
            for k in range(slices):
                if progress is not self.progress:
                    return
                part = missing.where(F.pmod(F.xxhash64("relative_path"), F.lit(slices)) == k)
                made = scratch.table(vectors.embed_files(part, self.provider).join(part.select("relative_path", "content_hash"), "relative_path"), f"vectors-{k}")
                while progress is self.progress:
                    state = self.warehouse.state()
                    # vectors of a file that has changed since are of no use
                    current = made.join(read("manifest", state), ["relative_path", "content_hash"], "left_semi").join(read("vectors", state).select("relative_path").distinct(), "relative_path", "left_anti")
                    try:
                        self.warehouse.commit(state["version"], {"vectors": current})
                        break
                    except SupersededError:
                        continue
                else:
                    return
                progress["done"] += part.count()
        finally:
            progress["active"] = False
            if tag:
                self.spark.sparkContext.removeJobTag(tag)
            scratch.drop()

    # --- Search ------------------------------------------------------------------------------------

    def _docs(self) -> DataFrame:
        kind = F.when(F.col("is_code"), "code").otherwise("docs").alias("kind")
        return self.warehouse.read("files").select("relative_path", kind, "content")

    def _clause_hits(self, clause: Clause, boosts: dict[str, float]) -> DataFrame:
        """relative_path, score of one clause; a phrase asks for its tokens side by side in one field.

        A word of which a field's analyzer makes several tokens (``a.b``, ``snake_case``) is one term of that field.
        """
        post, stats = self.warehouse.read("postings"), self.warehouse.read("field_stats")
        fields = (clause.field,) if clause.field else search.FIELDS
        weight = {f: boosts[f] * clause.boost for f in fields}
        if not clause.phrase:
            sequences = search.query_sequences(self.spark, clause.text, fields)
            scores = search.index_scores(post, stats, {f: t for f, t in sequences.items() if len(t) == 1}, weight)
            several = [search.phrase_scores(post, stats, f, t, weight[f]) for f, t in sequences.items() if len(t) > 1]
            return reduce(DataFrame.unionByName, several, scores).groupBy("relative_path").agg(F.sum("score").alias("score")) if several else scores
        tokens = search.query_tokens(self.spark, clause.text, fields)
        scores = search.index_scores(post, stats, tokens, weight)
        held = [search.phrase_matches(post, f, t).select("relative_path") for f, t in tokens.items() if t]
        return scores.join(reduce(DataFrame.union, held).distinct(), "relative_path", "left_semi") if held else scores.where("false")

    def _hits(self, clauses: Sequence[Clause | Group], boosts: dict[str, float]) -> DataFrame:
        """relative_path, score: the sum over clauses, with what each requires or excludes."""
        of = lambda c: self._clause_hits(c, boosts) if isinstance(c, Clause) else self._hits(c.clauses, {f: b * c.boost for f, b in boosts.items()})
        hits = [(c.occur, of(c)) for c in clauses]
        wanted = [h for occur, h in hits if occur != "not"]
        if not wanted:
            return self.spark.createDataFrame([], "relative_path string, score double")
        scored = reduce(DataFrame.unionByName, wanted).groupBy("relative_path").agg(F.sum("score").alias("score"))
        for occur, h in hits:
            if occur != "should":
                scored = scored.join(h.select("relative_path"), "relative_path", "left_semi" if occur == "must" else "left_anti")
        return scored

    def bm25(self, query: str, scope: str | None = "code", limit: int = 10) -> DataFrame:
        """path, score, kind of the best ``limit`` documents, before names count.  QueryError if it is no query."""
        boosts = dict(zip(search.FIELDS, analyze.BOOSTS[analyze.intent_of(query)], strict=True))
        scored = self._hits(parse(query), boosts)
        kinds = self._docs().select("relative_path", "kind")
        return search.top(search.scope_filter(scored.join(kinds, "relative_path"), scope), limit)

    def search(self, query: str, scope: str | None = "code", limit: int = 10) -> DataFrame:
        """path, score, snippet.  Hybrid if a provider is set and vectors are stored, else BM25 alone.

        A hit of its words shows the lines around them; one of its vectors alone shows the nearest chunk.
        """
        self.ensure()
        docs = self._docs()
        words = search.rerank_by_name(self.bm25(query, scope, OVERFETCH * limit), query).select("relative_path", "score")
        ranked = search.top(words, limit).withColumn("chunk", F.lit(None).cast("string"))
        stored = self.warehouse.read("vectors")
        if self.provider and not stored.isEmpty():
            query_vector = [float(x) for x in self.provider().embed([query])[0]]
            chunks = search.scope_filter(stored.join(docs.select("relative_path", "kind"), "relative_path"), scope)
            near = vectors.cosine_scores(chunks, query_vector).orderBy(F.desc("score"), "relative_path", "chunk_idx").limit(OVERFETCH * limit)
            best = vectors.best_per_key(near, "relative_path", "chunk_idx", "text")
            alone = best.join(words.select("relative_path"), "relative_path", "left_anti").select("relative_path", F.col("text").alias("chunk"))
            ranked = search.fuse(words, best.select("relative_path", "score"), limit).join(alone, "relative_path", "left")
        found = docs.join(F.broadcast(ranked), "relative_path")  # at most ``limit`` rows
        shown = F.coalesce("chunk", analyze.snippet(F.col("content"), query)).alias("snippet")
        return found.select(F.col("relative_path").alias("path"), "score", shown).orderBy(F.desc("score"), "path")

    # --- Graph -------------------------------------------------------------------------------------

    def graph(self, operation: str, file: str | None = None, target: str | None = None, max_length: int | None = None) -> DataFrame:
        """deps, dependents, cycles, components, path or impact.  Unknown files and missing arguments raise ValueError.

        Cycles are listed as :func:`graph.cycles` tells; ``max_length`` leaves out longer ones.  ``components`` gives the
        files of each component: all that import one another in circles.
        """
        if operation not in GRAPH_OPERATIONS:
            raise ValueError(f"unknown operation {operation!r}: use one of {', '.join(GRAPH_OPERATIONS)}")
        self.ensure()
        asked = [] if operation in ("cycles", "components") else [("file", file)] + ([("target", target)] if operation == "path" else [])
        for name, value in asked:
            if value is None:
                raise ValueError(f"{operation} needs {name!r}")
            if self.warehouse.read("manifest").where(F.col("relative_path") == value).isEmpty():
                raise ValueError(f"{value} is not indexed; check the path, or refresh")
        edges = self.warehouse.read("edges")
        if operation == "deps":
            return graph.deps(edges, file)
        if operation == "dependents":
            return graph.dependents(edges, file)
        if operation == "cycles":
            return graph.cycles(edges, max_length)
        if operation == "components":
            return graph.components(edges)
        return graph.shortest_path(edges, file, target) if operation == "path" else graph.impact(edges, file)

    # --- Status ------------------------------------------------------------------------------------

    def status(self) -> DataFrame:
        """One row: counts, parts, model, embedding job, watcher, root, pending paths, last update and readiness."""
        read, job = self.warehouse.read, self.progress
        task = f"{job['done']} of {job['total']} files embedded" if job["active"] else f"stopped: {job['error']}" if job["error"] else "idle"
        watcher = "none" if self.watcher is None else "running" if self.watcher.isActive else "stopped"
        return status_row(read("manifest"), read("vectors"), read("edges")).select(
            "*", F.col("documents").alias("graph_files"), F.lit(self.warehouse.segments("postings")).alias("segments"), F.lit("loaded" if self.provider else "not installed").alias("model"),
            F.lit(task).alias("task"), F.lit(watcher).alias("watcher"), F.lit(self.root).alias("root"), F.lit(self.pending["paths"]).cast("long").alias("pending"),
            F.lit(self.pending["last_update"]).cast("timestamp").alias("last_update"), F.lit(self.pending["seconds"]).cast("double").alias("update_seconds"),
            readiness(F.col("documents"), F.lit(bool(self.provider)), F.lit(job["active"])).alias("readiness"),
        )


def readiness(documents, has_model, embedding):
    """empty, embedding (words are searched meanwhile), hybrid or words."""
    return F.when(documents == 0, "empty").when(embedding, "embedding").when(has_model, "hybrid").otherwise("words")


def status_row(manifest: DataFrame, vecs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    return (
        manifest.agg(F.count(F.lit(1)).alias("documents")).crossJoin(vecs.agg(F.count(F.lit(1)).alias("vectors")))
        .crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each
    )
