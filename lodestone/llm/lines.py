"""Line dedup by pairwise alignment.

Documents that overlap are found through shared lines: every line that stands in several documents
proposes the earliest of them as partner of each later one, so candidates grow with the lines, never
with the square of a line's documents.  A document's partners are worked off from the one with the
rarest shared line on.  Each is aligned with patience diff: lines that occur once on both sides anchor
the alignment by their longest common order, and the stretches between are aligned in turn.  Aligned
common blocks of at least ``min_block_chars`` characters are deleted from the later document; what is
left meets the next partner.

That pass meets one holder a line.  With ``every_holder`` nothing is left that an earlier document has.  A window is a
least run of consecutive lines of ``min_block_chars`` characters; every block that can be deleted holds one.  While a
document has windows left that stand in an earlier one, it is aligned with the earliest holder of each, and windows
that this leaves (crossed with other blocks) are then aligned alone, as runs of their own.  So each window asks for
one holder, and a hot line costs one alignment for each of its documents, however many kinds of holders it has.
Rounds go on with the documents that lost lines, since what is left of those may have new windows.

Lines end at line feeds and are compared without spaces, tabs and carriage returns at their ends;
blank lines are neither compared nor counted, and go only with the last other line of a document.
Earlier is the smaller id; a null id is smaller than any other.  Rows that repeat an id are told apart
by their text and are not earlier than one another.  Null texts stay null, empty ones empty.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.memory import lean
from lodestone.runtime import Scratch

MIN_BLOCK_CHARS = 30
KEY_BYTES = 16
NO_ID = -(1 << 63)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs (sorted by the first) whose second members rise."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _occurrences(items: Sequence, lo: int, hi: int) -> dict[tuple, int]:
    """Positions in order, by item and how many equal ones come before it."""
    seen: Counter = Counter()
    out = {}
    for k in range(lo, hi):
        out[items[k], seen[items[k]]] = k
        seen[items[k]] += 1
    return out


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned positions of equal items, rising on both sides."""
    found: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, i_end, j, j_end = work.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i >= i_end or j >= j_end:
            continue
        count_a, count_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        where = {b[k]: k for k in range(j, j_end) if count_b[b[k]] == 1}
        anchors = _rising([(k, where[a[k]]) for k in range(i, i_end) if count_a[a[k]] == 1 and a[k] in where])
        if not anchors:
            # lines that repeat on both sides: the k-th on one side anchors with the k-th on the other
            places = _occurrences(b, j, j_end)
            anchors = _rising([(x, places[item]) for item, x in _occurrences(a, i, i_end).items() if item in places])
        if not anchors:
            continue
        for x, y in anchors:
            work.append((i, x, j, y))
            i, j = x, y
            found.append((x, y))
            i, j = x + 1, y + 1
        work.append((i, i_end, j, j_end))
    return sorted(found)


def common_blocks(pairs: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Positions of the first sequence, one list for each block that is unbroken on both sides."""
    block: list[int] = []
    last = None
    for i, j in pairs:
        if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
            yield block
            block = []
        block.append(i)
        last = (i, j)
    if block:
        yield block


def delete_common(own: list, sizes: list[int], alive: list[int], other: list, least: int) -> list[int]:
    """What stays of ``alive`` (positions in ``own``) after alignment with an earlier document."""
    gone = set()
    for block in common_blocks(patience([own[k] for k in alive], other)):
        lines = [alive[k] for k in block]
        if sum(sizes[k] for k in lines) >= least:
            gone.update(lines)
    return [k for k in alive if k not in gone] if gone else alive


def window_spans(keys: Sequence[bytes], sizes: Sequence[int], least: int) -> Iterator[tuple[int, int, bytes]]:
    """(begin, end, digest) of the least runs of consecutive lines, from each line on, that have ``least`` characters."""
    end = chars = 0
    for k in range(len(keys)):
        while end < len(keys) and (end == k or chars < least):
            chars += sizes[end]
            end += 1
        if chars < least:
            return
        yield k, end, md5(b"".join(keys[k:end])).digest()
        chars -= sizes[k]


def windows(keys: Sequence[bytes], sizes: Sequence[int], least: int) -> list[bytes]:
    """The distinct digests of :func:`window_spans`."""
    return list(dict.fromkeys(w for _, _, w in window_spans(keys, sizes, least)))


def split_keys(raw: bytes) -> list[bytes]:
    return [raw[k : k + KEY_BYTES] for k in range(0, len(raw), KEY_BYTES)]


STATE = "id long, mark long, gone binary, changed boolean, windows array<binary>"
_KINDS = {"id": pa.int64(), "mark": pa.int64(), "gone": pa.binary(), "changed": pa.bool_(), "windows": pa.list_(pa.binary())}


def _alive(own: list[bytes], lost: bytes | None) -> list[int]:
    """Positions that are left, from a bit for each that is lost."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(lost or bytes(len(own)), np.uint8), count=len(own)) == 0).tolist()


def _state(own: list[bytes], sizes: list[int], alive: list[int], before: int, least: int, with_windows: bool) -> tuple:
    """gone, changed and windows of a document."""
    flags = np.ones(len(own), dtype=np.uint8)
    flags[alive] = 0
    gone = np.packbits(flags).tobytes() if len(alive) < len(own) else None
    return gone, len(alive) < before, windows([own[k] for k in alive], [sizes[k] for k in alive], least) if with_windows else []


def _states(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _KINDS.values(), strict=True)], names=list(_KINDS))


def _align(batches: Iterator[pa.RecordBatch], least: int, every_holder: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document, its own lines first, then its partners': what is removed and what is left."""
    key, own, sizes, alive, before, last = None, [], [], [], 0, None
    out: list[tuple] = []

    def close() -> None:
        if key is not None:
            out.append((*key, *_state(own, sizes, alive, before, least, every_holder)))

    for batch in batches:
        for i, mark, turn, keys, chars, lost, *partner in zip(*(batch.column(c) for c in ("id", "mark", "turn", "keys", "chars", "lost", "other", "other_mark")), strict=True):
            if turn.as_py() < 0:
                if (i.as_py(), mark.as_py()) == key:
                    continue  # an equal row
                close()
                key, own, sizes = (i.as_py(), mark.as_py()), split_keys(keys.as_py()), chars.as_py()
                alive = _alive(own, lost.as_py())
                before, last = len(alive), None
            elif alive:
                met = (partner[0].as_py(), partner[1].as_py(), keys.as_py())
                if met == last:
                    continue  # an equal row of the partner
                last = met
                alive = delete_common(own, sizes, alive, split_keys(keys.as_py()), least)
        if len(out) > 5000:
            yield _states(out)
            out.clear()
    close()
    yield _states(out)


def _window_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The distinct windows of whole documents."""
    for batch in batches:
        seen = [windows(split_keys(k.as_py()), c.as_py(), least) for k, c in zip(batch.column("keys"), batch.column("chars"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(seen, pa.list_(pa.binary()))], names=["id", "mark", "windows"])


def _cut_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, mark, keys, chars, gone, open) without the runs whose windows are open, each aligned alone."""
    for batch in batches:
        out = []
        for i, mark, keys, chars, lost, wanted in zip(*(batch.column(c) for c in ("id", "mark", "keys", "chars", "gone", "open")), strict=True):
            own, sizes, asked = split_keys(keys.as_py()), chars.as_py(), set(wanted.as_py())
            alive = _alive(own, lost.as_py())
            cut: set[int] = set()
            for lo, hi, window in window_spans([own[k] for k in alive], [sizes[k] for k in alive], least):
                if window in asked:
                    cut.update(alive[lo:hi])
            left = [k for k in alive if k not in cut]
            out.append((i.as_py(), mark.as_py(), *_state(own, sizes, left, len(alive), least, True)))
        yield _states(out)


def _join(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join at any size: no side's size is bounded, so none is broadcast."""
    return a.join(b.hint("merge"), on, how)


def _aligned(rows: DataFrame, theirs: DataFrame, who: DataFrame, lost: DataFrame | None, least: int, every_holder: bool) -> DataFrame:
    """``rows`` of ``who`` after alignment with ``theirs``, from what ``lost`` (id, mark, gone) left on."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = _join(rows, who.select("id", "mark").distinct(), ["id", "mark"], "left_semi")
    mine = mine.withColumn("lost", F.lit(None).cast("binary")) if lost is None else _join(mine, lost.select("id", "mark", F.col("gone").alias("lost")), ["id", "mark"])
    none = F.lit(0).cast("long")
    mine = mine.select("id", "mark", F.lit(-1).cast("long").alias("turn"), none.alias("other"), none.alias("other_mark"), "keys", "chars", "lost")
    theirs = theirs.select("id", "mark", "turn", "other", "other_mark", "keys", F.lit(None).cast("array<int>").alias("chars"), F.lit(None).cast("binary").alias("lost"))
    dealt = mine.union(theirs).repartition(parts, "id", "mark").sortWithinPartitions("id", "mark", "turn", "other", "other_mark", "keys")
    return dealt.mapInArrow(lean(lambda it: _align(it, least, every_holder)), STATE)


def _other_holders(rows: DataFrame, state: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """``state`` without what any earlier document has, in rounds until no window of what is left stands earlier."""
    whole = rows.mapInArrow(lean(lambda it: _window_rows(it, least)), "id long, mark long, windows array<binary>").select("id", "mark", F.explode("windows").alias("window"))
    # windows of one holder too: lines of a later document may have come together by what it lost
    firsts = scratch.table(whole.groupBy("window").agg(F.min(F.struct("id", "mark")).alias("first")), "first-windows")  # so that the join with a hot window is plain and AQE can split it
    single = rows.dropDuplicates(["id", "mark"])
    states, todo, turn = [state.withColumn("turn", F.lit(0))], state, 0
    while True:
        turn += 1
        left = _join(todo.select("id", "mark", F.explode("windows").alias("window")), firsts, "window").where("id > first.id")
        left = scratch.table(left.select("id", "mark", "window", "first"), f"open-{turn}")
        if left.isEmpty():
            break
        if turn % 2:  # with the earliest holder of each window
            opened = _join(todo, left.select("id", "mark").distinct(), ["id", "mark"], "left_semi")
            pairs = left.select("id", "mark", F.col("first.id").alias("other"), F.col("first.mark").alias("other_mark")).distinct()
            partner = rows.select(F.col("id").alias("other"), F.col("mark").alias("other_mark"), "keys")
            theirs = _join(pairs, partner, ["other", "other_mark"]).select("id", "mark", F.lit(0).cast("long").alias("turn"), "other", "other_mark", "keys")
            done = scratch.table(_aligned(rows, theirs, opened, opened, least, True), f"aligned-{turn}")
            todo = done
        else:  # windows that are left, alone
            asked = left.groupBy("id", "mark").agg(F.collect_list("window").alias("open"))
            mine = _join(_join(single.select("id", "mark", "keys", "chars"), todo.select("id", "mark", "gone"), ["id", "mark"]), asked, ["id", "mark"])
            done = scratch.table(mine.mapInArrow(lean(lambda it: _cut_rows(it, least)), STATE), f"cut-{turn}")
            todo = done.where("changed")
        states.append(done.withColumn("turn", F.lit(turn)))
    out = states[0]
    for more in states[1:]:
        out = out.union(more)
    return out.groupBy("id", "mark").agg(F.max_by("gone", "turn").alias("gone")) if len(states) > 1 else out


def removed_lines(documents: DataFrame, scratch: Scratch, least: int = MIN_BLOCK_CHARS, every_holder: bool = False) -> DataFrame:
    """(id, mark, gone): for documents that lose lines, a bit for each non-blank line."""
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    lines = documents.select("id", "mark", F.filter(trimmed, lambda x: x != "").alias("lines")).where(F.size("lines") > 0)
    rows = scratch.table(
        lines.select(
            "id", "mark", F.unhex(F.array_join(F.transform("lines", lambda x: F.md5(F.encode(x, "UTF-8"))), "")).alias("keys"),
            F.transform("lines", F.length).alias("chars"),
        ), "lines",
    )
    width = 2 * KEY_BYTES
    at = F.sequence(F.lit(0), F.size("chars") - 1)
    hexed = rows.withColumn("hexed", F.hex("keys"))
    each = hexed.select("id", "mark", F.explode(F.array_distinct(F.transform(at, lambda k: F.substring(F.col("hexed"), k * width + 1, F.lit(width))))).alias("line"))
    first = each.groupBy("line").agg(F.min(F.struct("id", "mark")).alias("first"), F.count(F.lit(1)).alias("holders")).where("holders > 1")
    first = scratch.table(first, "first")  # so that the join with a hot line is plain and AQE can split it
    met = _join(each, first, "line").where("id > first.id").select("id", "mark", F.col("first.id").alias("other"), F.col("first.mark").alias("other_mark"), "holders")
    pairs = scratch.table(met.groupBy("id", "mark", "other", "other_mark").agg(F.min("holders").alias("turn")), "pairs")
    # not made distinct, so that the join with a hot partner is plain and AQE can split it; equal rows align once
    partner = rows.select(F.col("id").alias("other"), F.col("mark").alias("other_mark"), "keys")
    theirs = _join(pairs, partner, ["other", "other_mark"]).select("id", "mark", "turn", "other", "other_mark", "keys")
    state = scratch.table(_aligned(rows, theirs, pairs, None, least, every_holder), "aligned")
    if every_holder:
        state = _other_holders(rows, state, scratch, least)
    return scratch.table(state.where("gone is not null").select("id", "mark", "gone"), "gone")


def strip_lines(text: str, gone: bytes) -> tuple[str, int, int]:
    """The text without its removed lines, how many there were, and how many go."""
    lines = text.split("\n")
    real = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
    flags = np.unpackbits(np.frombuffer(gone, np.uint8), count=len(real)).astype(bool).tolist()
    drop = {k for k, g in zip(real, flags, strict=True) if g}
    return ("" if len(drop) == len(real) else "\n".join([x for k, x in enumerate(lines) if k not in drop])), len(real), len(drop)


def dedup_lines(documents: DataFrame, scratch: Scratch | None = None, doc_id: str = "doc_id", text: str = "text", least: int = MIN_BLOCK_CHARS, every_holder: bool = False) -> DataFrame:
    """``documents`` with the kept text in place of the text, and n_lines and n_removed (non-blank lines).

    Only with ``every_holder`` is the job whole; without it a line meets its earliest holder alone.
    Columns named n_lines or n_removed are replaced; all others stay, whatever their names.
    """
    scratch = scratch or Scratch(documents.sparkSession, "lines")
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    whole = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("mark"), F.struct(*names).alias("row"))
    gone = removed_lines(whole.select("id", "mark", F.coalesce(F.col(f"row.{text}"), F.lit("")).alias("text")), scratch, least, every_holder)
    extra = "gone"
    while extra in {c.lower() for c in names}:
        extra += "_"
    joined = _join(whole, gone, ["id", "mark"], "left").select("row.*", F.col("gone").alias(extra))
    schema = T.StructType([*(documents.schema[c] for c in names), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed = [], [], []
            for t, g in zip(batch.column(names.index(text)), batch.column(batch.num_columns - 1), strict=True):
                t = t.as_py()
                if t is None:
                    row = (None, 0, 0)
                elif g.is_valid:
                    row = strip_lines(t, g.as_py())
                else:
                    row = (t, sum(1 for x in t.split("\n") if x.strip(" \t\r")), 0)
                texts.append(row[0])
                totals.append(row[1])
                removed.append(row[2])
            columns = list(batch.columns[:-1])
            columns[names.index(text)] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=[f.name for f in schema.fields])

    return joined.mapInArrow(lean(run), schema)
