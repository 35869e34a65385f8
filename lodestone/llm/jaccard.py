"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when their sets of distinct word 5-grams have Jaccard similarity of at least 0.8.
The shingles of each set are put in one global order, rare ones first; two sets that link share at least
k of their first ``n - ceil(0.8 n) + k`` shingles, for every k.  Each document picks its own k: where the
estimated number of candidates of its plain prefix is high, its prefix grows and more matches are asked
of a candidate before it is verified.  The order and the estimate come from a frequency sketch of fixed
size over the shingles of all documents; results do not depend on it.

Documents with equal sets form one class, joined once.  Candidates are worked off in two steps, so that
groups of near copies never meet in all their pairs:

1. Every posting list is sorted by min-hashes and each member is verified against the one before it:
   as many candidates as postings.  The links found give provisional components.
2. Only posting lists that still hold several components are searched completely, and only across
   components, and always by the number of shared prefix shingles: short lists as pairs; long ones (over
   LONG_LIST) block by block, where the members' whole prefixes meet, and those with a candidate are
   verified within tasks that return the links needed to connect their members.

All links are verified on whole sets.  The classes' components are the answer; pairs within a component
are not listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import UnionFind, connected_components
from lodestone.functions.memory import lean
from lodestone.llm.words import blocks, mix, shingle_set
from lodestone.runtime import Scratch

SHINGLE_WORDS = 5
SKETCH_BITS, SLICES = 20, 64
LONG_LIST, BLOCK_ROWS, BLOCK_SHINGLES, MAX_EXTRA = 64, 1024, 1 << 21, 7
_U = np.uint64


def required(n: int) -> int:
    """The least overlap of a set of n with any set at similarity 0.8 or more."""
    return (4 * n + 4) // 5


def _sets(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    for w in blocks(batch.column(column)):
        h = w.hashes(fold=True)
        for k in range(len(w)):
            yield shingle_set(h[w.bounds[k] : w.bounds[k + 1]], SHINGLE_WORDS)


def frequency_sketch(df: DataFrame, text: str = "text") -> np.ndarray:
    """How many documents' shingles fall into each of 2^20 buckets: 4 MB whatever the input."""
    width = (1 << SKETCH_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            part: list[np.ndarray] = []
            for s in _sets(batch, text):
                part.append(s)
                if len(part) == 2000:
                    counts += np.bincount((np.concatenate(part) >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                    part = []
            if part:
                counts += np.bincount((np.concatenate(part) >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        if counts.any():
            yield _slices(counts)

    def _slices(counts: np.ndarray) -> pa.RecordBatch:
        cut = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32).reshape(SLICES, width)
        return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), dtype=np.uint32).astype(np.int64)
                sums[k] = np.minimum(sums[k] + own, 0xFFFFFFFF) if k in sums else own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.astype(np.uint32).tobytes() for s in sums.values()], pa.binary())], names=["slice", "counts"]
        )

    schema = "slice int, counts binary"
    out = np.zeros((SLICES, width), dtype=np.uint32)
    for row in df.select(text).mapInArrow(lean(count), schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect():
        out[row.slice] = np.frombuffer(row.counts, dtype=np.uint32)
    return out.ravel()


def matches_wanted(frequencies: np.ndarray, background: float) -> int:
    """Shared prefix shingles asked of a candidate, from the postings its plain prefix would meet."""
    cost = float(np.maximum(frequencies - background - 3 * math.sqrt(background + 1), 0).sum())
    return 1 + min(MAX_EXTRA, int(math.log2(1 + cost / 16)))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two 16-bit min-hashes as one 31-bit number (the top bit of the first is dropped)."""
    return ((a & 0x7FFF) << 16) | b


def signatures(df: DataFrame, sketch: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (set size), key (128 bits of the set), wanted, prefix, and four min-hashes in two longs."""
    shared = df.sparkSession.sparkContext.broadcast(sketch)
    background = float(sketch.mean()) if len(sketch) else 0.0
    seeds = [_U(0x632BE59BD9B4E019), _U(0xE6546B64D85E9D13), _U(0x9FB21C651E98DF25), _U(0xC13FA9A902A6328F)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            sizes, keys, wanted, prefixes, ends, mins = [], [], [], [], [0], []
            for s in _sets(batch, "text"):
                n = len(s)
                sizes.append(n)
                a = mix(s + _U(1))
                keys.append(np.array([a.sum(dtype=_U), mix(s ^ seeds[0]).sum(dtype=_U)], dtype=_U).tobytes())
                if n:
                    often = counts[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)]
                    order = np.lexsort((s, often))
                    base = n - required(n) + 1
                    k = min(matches_wanted(often[order[:base]].astype(np.float64), background), required(n))
                    wanted.append(k)
                    own = s[order[: base + k - 1]].view(np.int64)
                    mins.append([int(mix(s * m).min() >> _U(48)) for m in seeds])
                else:
                    wanted.append(0)
                    own = np.zeros(0, np.int64)
                    mins.append([0, 0, 0, 0])
                prefixes.append(own)
                ends.append(ends[-1] + len(own))
            m = np.array(mins, dtype=np.int64).reshape(-1, 4)
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(wanted, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(_near(m[:, 0], m[:, 1])), pa.array(_near(m[:, 2], m[:, 3])),
                ],
                names=["doc_id", "n", "key", "wanted", "prefix", "near_a", "near_b"],
            )

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).mapInArrow(
        lean(run), "doc_id long, n long, key binary, wanted int, prefix array<long>, near_a long, near_b long"
    )


def _shared_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by shingle, those whose shingle may occur again, with the member before where the
    two agree on both min-hashes and their sizes allow a link.

    A list can go on in the next partition, so the first and the last posting of a partition always stay.
    """
    held: pa.RecordBatch | None = None
    last: tuple[int, int, int] | None = None  # token, info, rep just before ``held``
    begun = False

    def emit(batch: pa.RecordBatch, following: int | None) -> pa.RecordBatch:
        nonlocal last
        token, info, rep = (batch.column(c).to_numpy() for c in ("token", "info", "rep"))
        before = [np.roll(x, 1) for x in (token, info, rep)]
        if last is not None:
            for x, value in zip(before, last, strict=True):
                x[0] = value
        same = token == before[0]
        if last is None:
            same[0] = False
        keep = same | np.append(same[1:], following is not None and token[-1] == following)
        keep[0] |= not begun
        keep[-1] |= following is None
        n, m = (info & 0xFFFFFFFF) >> 5, (before[1] & 0xFFFFFFFF) >> 5
        pair = same & (rep != before[2]) & (info >> 32 == before[1] >> 32) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
        last = (int(token[-1]), int(info[-1]), int(rep[-1]))
        out = pa.RecordBatch.from_arrays([batch.column("token"), batch.column("rep"), batch.column("info"), pa.array(before[2], mask=~pair)], names=["token", "rep", "info", "before"])
        return out.filter(pa.array(keep))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield emit(held, batch.column("token")[0].as_py())
            begun = True
        held = batch
    if held is not None:
        yield emit(held, None)


def _intersections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar enough."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for k, (a, b) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
            a, b = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
            keep[k] = linked(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def linked(n: int, m: int, common: int) -> bool:
    return 100 * common >= 80 * (n + m - common) and common > 0


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two (different) of some sets have in common."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = counts[inverse] > 1
    row, inverse = row[several], inverse[several]
    columns, inverse = np.unique(inverse, return_inverse=True)
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(inverse, kind="stable")
    row, inverse = row[order], inverse[order]
    for lo in range(0, len(columns), 1024):
        i, j = np.searchsorted(inverse, [lo, lo + 1024])
        part = np.zeros((len(sets), min(1024, len(columns) - lo)), dtype=np.float32)
        part[row[i:j], inverse[i:j] - lo] = 1
        common += part @ part.T
    return common


def block_links(reps: list[int], comps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between members of different components, as many as it takes to connect them."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    common, comp, found = overlaps(sets), np.array(comps), []
    for lo in range(0, len(sets), 256):
        c = np.rint(common[lo : lo + 256]).astype(np.int64)
        hit = 100 * c >= 80 * (sizes[lo : lo + 256, None] + sizes[None, :] - c)
        found.append(np.argwhere(hit & (comp[lo : lo + 256, None] < comp[None, :])) + [lo, 0])
    a, b = np.concatenate(found).T
    known, out = UnionFind(), []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if known.union(comps[x], comps[y]):
            out.append((reps[x], reps[y]))
    return out


def candidates_of(n: np.ndarray, wanted: np.ndarray, comps: np.ndarray, prefixes: list[np.ndarray]) -> np.ndarray:
    """Members with a candidate of another component: one that shares as many prefix shingles as either asks for.

    A prefix shingle of the set whose prefix ends first is missing from the other set unless it matches, so that
    set has at most ``n - prefix + matches`` in common with it, where 4/9 of both sizes together must be.
    """
    common, rest = overlaps(prefixes), (4 * n + 4) // 5 - wanted
    keep = np.zeros(len(n), dtype=bool)
    for lo in range(0, len(n), 256):
        own = slice(lo, lo + 256)
        needed = np.maximum(np.minimum(wanted[own, None], wanted), (4 * (n[own, None] + n) + 8) // 9 - np.maximum(rest[own, None], rest))
        alike = 5 * np.minimum(n[own, None], n) >= 4 * np.maximum(n[own, None], n)
        keep[own] = (alike & (comps[own, None] != comps) & (np.rint(common[own]) >= needed)).any(axis=1)
    return keep


def _screen_block(table: pa.Table) -> pa.Table:
    """The members of a block that have candidates."""
    if not table.num_rows:
        return table.select(["token", "i", "j", "rep", "comp"])
    prefixes = [np.asarray(p.values) for p in table["prefix"].combine_chunks()]
    keep = candidates_of(table["n"].to_numpy(), table["wanted"].to_numpy().astype(np.int64), table["comp"].to_numpy(), prefixes)
    return table.select(["token", "i", "j", "rep", "comp"]).filter(pa.array(keep))


def _search_block(table: pa.Table) -> pa.Table:
    rows = {r: (c, s) for r, c, s in zip(table["rep"].to_pylist(), table["comp"].to_pylist(), table["set"].combine_chunks() if table["set"].num_chunks != 1 else table["set"].chunk(0), strict=True)}
    reps = sorted(rows)
    found = []
    if len({c for c, _ in rows.values()}) > 1:
        found = block_links(reps, [rows[r][0] for r in reps], [np.frombuffer(rows[r][1].as_buffer(), _U) for r in reps])
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")


def near_duplicates(documents: DataFrame, scratch: Scratch | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row of ``documents``.

    class_id is the smallest id with the same set, component_id the smallest id reachable by links.
    Null and empty texts, and texts without a word, have an empty set and stand alone.  A row without an
    id takes no part in links and has no class.  Rows that repeat an id are judged each by its text.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    documents = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sigs = scratch.table(signatures(documents, frequency_sketch(documents)), "signatures")
    real = sigs.where("n > 0 and doc_id is not null")
    # a table of its own, so that the joins with a hot class are plain and AQE can split them
    classes = scratch.table(real.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    members = scratch.table(real.select("doc_id", "n", "key").join(classes, "key").select("doc_id", "n", "rep"), "members")
    heads = real.join(classes.withColumnRenamed("rep", "doc_id"), ["key", "doc_id"], "left_semi").withColumnRenamed("doc_id", "rep")
    # min-hashes, size, whether the plain prefix has ended, and matches wanted travel as one number: 31, 27, 1 and 4 bits
    extra = F.expr("cast(at > n - (4 * n + 4) div 5 as int)")
    packed = lambda near: F.shiftleft(near, 32) + F.col("n") * 32 + extra * 16 + F.col("wanted")
    opened = heads.select(F.posexplode("prefix").alias("at", "token"), "rep", "n", "wanted", "near_a", "near_b")
    postings = opened.select("token", "rep", packed(F.col("near_a")).alias("a"), packed(F.col("near_b")).alias("b")).select(
        "token", "rep", F.when(F.col("token") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("info")
    )
    ranged = postings.repartitionByRange(parts, "token", "info", "rep").sortWithinPartitions("token", "info", "rep")
    shared = scratch.table(ranged.mapInArrow(lean(_shared_postings), "token long, rep long, info long, before long"), "shared")
    scratch.release()

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets(batch, "text")], pa.binary())], names=["rep", "set"])

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        own = documents.withColumnRenamed("doc_id", "rep").join(ids, "rep", "left_semi")
        out = scratch.table(own.mapInArrow(lean(to_sets), "rep long, set binary"), name)
        scratch.release()
        return out

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()

    # step 1: neighbours in sorted posting lists
    pairs = scratch.table(shared.where("before is not null").select(F.least("rep", "before").alias("a"), F.greatest("rep", "before").alias("b")).distinct(), "pairs")
    first = connected_components(_with_sets(pairs, sets_of(ends(pairs), "sets-1")), scratch, "first", _intersections)
    scratch.drop("sets-1")
    scratch.release()

    # step 2: what is left between components
    unpacked = shared.select("token", "rep", F.expr("cast((info & 4294967295) div 32 as int)").alias("n"), F.expr("cast(info & 15 as int)").alias("wanted"), F.expr("info & 16 = 0").alias("plain"))
    labelled = unpacked.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    live = labelled.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("comp").alias("low"), F.max("comp").alias("high")
    ).where("low < high").select("token", "size", "shingles")
    open_lists = scratch.table(labelled.join(live, "token"), "open")
    long = open_lists.where(F.col("size") > LONG_LIST)
    in_long = long.groupBy("rep").agg(F.count(F.lit(1)).cast("int").alias("in_long"))
    short = open_lists.where(F.col("size") <= LONG_LIST).join(in_long, "rep", "left").na.fill(0, ["in_long"])
    x = short.select("token", *(F.col(c).alias(f"{c}_a") for c in ("rep", "n", "wanted", "comp", "in_long")))
    y = short.select("token", *(F.col(c).alias(f"{c}_b") for c in ("rep", "n", "wanted", "comp", "in_long")))
    # A prefix shingle of the set whose prefix ends first is missing from the other set unless it matches, so of
    # n shingles at most (n - prefix + matches) can be common, where 4/9 of both sizes together must be.
    rest = "greatest((4 * n_a + 4) div 5 - wanted_a, (4 * n_b + 4) div 5 - wanted_b)"
    needed = F.expr(f"greatest(least(wanted_a, wanted_b), (4L * (n_a + n_b) + 8) div 9 - {rest}) - least(in_long_a, in_long_b)")
    candidates = (
        x.join(y, "token").where("rep_a < rep_b and comp_a <> comp_b and 5L * least(n_a, n_b) >= 4L * greatest(n_a, n_b)")
        .groupBy(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        .agg(F.count(F.lit(1)).alias("matches"), F.max(needed).alias("needed"))
        .where("matches >= needed").select("a", "b")
    )
    candidates = scratch.table(candidates, "candidates")
    long = long.where("plain")  # any two sets that link share a shingle of their plain prefixes
    sets = sets_of(ends(candidates).union(long.select("rep").distinct()), "sets-2")
    n_blocks = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = (
        long.withColumn("blocks", n_blocks).withColumn("own", F.pmod(F.hash("rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "comp")
    )

    # whole prefixes meet first; only members with a candidate bring their sets
    cell = ["token", "i", "j"]
    screened = dealt.join(heads.select("rep", "n", "wanted", "prefix"), "rep").groupBy(*cell).applyInArrow(_screen_block, "token long, i int, j int, rep long, comp long")
    in_blocks = screened.join(sets, "rep").groupBy(*cell).applyInArrow(_search_block, "a long, b long")
    late = scratch.table(_with_sets(candidates, sets).mapInArrow(lean(_intersections), "a long, b long").union(in_blocks), "late")
    final = scratch.table(first, "labels")
    if not late.isEmpty():
        name = first.toDF("node", "component")
        bridges = (
            late.join(name.toDF("a", "ca"), "a", "left").join(name.toDF("b", "cb"), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        )
        second = connected_components(bridges, scratch, "second").toDF("component", "joined")
        grown = first.join(second, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
        alone = second.join(first.select(F.col("node").alias("component")), "component", "left_anti").toDF("node", "component")
        final = scratch.table(grown.union(alone), "final")
    for name in ("classes", "shared", "sets-2", "open", "pairs", "candidates", "first", "second", "first-1", "late"):
        scratch.drop(name)
    scratch.release()
    placed = members.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), F.col("rep").alias("class_id")
    )
    bare = sigs.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return placed.union(bare)
