"""Byte-level BPE encoding and decoding by a pair occurrence index.

All distinct pre-tokens of a stretch of texts are laid out as one symbol array with links to the
symbol before and after.  An index maps every merge rule to the positions where its pair stands.
Rules are applied in ascending rank, each to all of its positions at once; only the pairs beside a
merged symbol change, and their new positions are filed under the rules they now match.

The vocabulary file is a parameter.  Texts are processed whole; null and empty texts have no tokens.
Special tokens of the file are recognised in the text before anything else, as the file's own
library does.
"""

from __future__ import annotations

import hashlib
import gc
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.functions.memory import lean

#: Text handed to one run of the merge loop, in characters.
RUN_CHARS = 3 << 20

#: The published split pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], _byte_of_char()
        ids: dict[str, int] = model["vocab"]
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.size = 1 + max([*ids.values(), *specials.values()])
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in specials.items():
            self.bytes_of[i] = token.encode()
        self.text_of = pa.array([b"%d," % i for i in range(self.size)], pa.large_binary())
        self.decoded = pa.array(self.bytes_of, pa.large_binary())
        self.specials = specials
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(specials, key=len, reverse=True))) if specials else None
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for c, b in to_byte.items():
            self.byte_ids[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        keys = self.left * self.size + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order.astype(np.int32)
        self.byte_ranks = self.ranks(*(x.ravel() for x in np.meshgrid(self.byte_ids, self.byte_ids, indexing="ij")))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, or -1."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of_key[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_pieces(vocab: Vocabulary, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces (their bytes after one another, and the length of each), and where each piece's ids begin (one more entry)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(lengths) + 1, np.int64)
    symbol = vocab.byte_ids[data]
    piece = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    after = np.arange(1, n + 1, dtype=np.int32)
    after[np.append(piece[1:] != piece[:-1], True)] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[np.append(True, piece[1:] != piece[:-1])] = -1

    places: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def file(at: np.ndarray, rank: np.ndarray | None = None) -> None:
        """Put positions under the rule that their pair matches now."""
        if rank is None:
            rank = vocab.ranks(symbol[at], symbol[after[at]])
        known = rank >= 0
        if not known.any():
            return
        at, rank = at[known], rank[known]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        heads = rank[np.append(0, cuts)].tolist()
        for r, part in zip(heads, np.split(at, cuts) if len(cuts) else [at], strict=True):
            if r in places:
                places[r].append(part)
            else:
                places[r] = [part]
                heapq.heappush(active, r)

    first = np.flatnonzero(after >= 0).astype(np.int32)
    file(first, vocab.byte_ranks[data[first].astype(np.int32) * 256 + data[first + 1]])
    while active:
        r = heapq.heappop(active)
        parts = places.pop(r)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if len(at) > 1:
            at = np.sort(at)
            at = at[np.append(True, at[1:] != at[:-1])]
        a, b = vocab.left[r], vocab.right[r]
        at = at[(symbol[at] == a) & (after[at] >= 0)]
        at = at[symbol[after[at]] == b]
        if not len(at):
            continue
        if a == b and len(at) > 1:  # a run of equal symbols is paired from its left end
            joined = after[at[:-1]] == at[1:]
            index = np.arange(len(at))
            begun = np.maximum.accumulate(np.where(np.append(True, ~joined), index, 0))
            at = at[(index - begun) % 2 == 0]
        gone = after[at]
        symbol[at] = vocab.made[r]
        symbol[gone] = -1
        far = after[gone]
        after[at] = far
        has = far >= 0
        before[far[has]] = at[has]
        back = before[at]
        file(np.concatenate([back[back >= 0], at[has]]))
    left = symbol >= 0
    return symbol[left], np.searchsorted(piece[left], np.arange(len(lengths) + 1))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of runs given by start and length, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Units:
    """The distinct units of a stretch of texts: the ids of unit k are ``ids[bounds[k] : bounds[k + 1]]``."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        self.ids, self.bounds = ids, bounds

    def __getitem__(self, k: int) -> list[int]:
        return self.ids[self.bounds[k] : self.bounds[k + 1]].tolist()

    def joined(self, token_bytes: pa.LargeBinaryArray, units: np.ndarray, ends: np.ndarray) -> tuple[memoryview, list[int]]:
        """The bytes of the tokens of ``units``, and where in them the units before each of ``ends`` end."""
        offsets, data = _buffers(token_bytes.take(pa.array(self.ids)))
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.bounds) - 1, [None, pa.py_buffer(offsets[self.bounds].tobytes()), pa.py_buffer(data)])
        offsets, data = _buffers(own.take(pa.array(units)))
        return data, offsets[ends].tolist()


def _buffers(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets (one more than values) and bytes of a large string or binary array."""
    _, offsets, data = column.buffers()
    if offsets is None or not offsets.size:
        return np.zeros(1, np.int64), memoryview(b"")
    offsets = np.frombuffer(offsets, np.int64, count=len(column) + 1, offset=8 * column.offset)
    return offsets, memoryview(data if data is not None else b"")


class Encoder:
    """Encodes texts a stretch at a time.

    A unit is what stands between two spaces, with the space before it.  Where no space has white
    space after it, units split exactly at pre-token borders, so a text is its units' tokens after one
    another.  The units of other texts are their pre-tokens and special tokens.
    """

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.find = regex.compile(PATTERN).findall
        self.odd = re.compile(r" (?:\s|\Z)").search
        self.known = Units(np.zeros(0, np.int64), np.zeros(1, np.int64))

    def pieces(self, unit: str) -> list[str]:
        """The pre-tokens of a unit, which comes without the space before it; the first of a text, with none, is marked by one."""
        if unit.isalpha():
            return [" " + unit]
        if unit[:-1].isalpha() and unit[-1] in ".,":
            return [" " + unit[:-1], unit[-1]]
        return self.find(unit[1:] if unit.startswith(" ") else " " + unit)

    def odd_pieces(self, text: str) -> list[str | int]:
        """The pre-tokens of a whole text; a special token stands as its id."""
        special = self.vocab.special_pattern
        out, at = [], 0
        for found in special.finditer(text) if special is not None else ():
            out += [*self.find(text[at : found.start()]), self.vocab.specials[found[0]]]
            at = found.end()
        return out + self.find(text[at:])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], Units]:
        """Each text as numbers of its units, and the units; ``known`` is the units of the last call."""
        special = self.vocab.special_pattern
        odd = [bool(self.odd(t)) or (special is not None and special.search(t) is not None) for t in texts]
        split = pc.split_pattern(pa.array([t for t, o in zip(texts, odd, strict=True) if t and not o], pa.large_string()), " ")
        flat, offsets = split.values, split.offsets.to_numpy()
        if len(flat):
            heads, none = np.zeros(len(flat), dtype=bool), pa.scalar("", pa.large_string())
            heads[offsets[:-1]] = True
            flat = pc.replace_with_mask(flat, pa.array(heads), pc.binary_join_element_wise(none, flat.filter(pa.array(heads)), pa.scalar(" ", pa.large_string())))
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy()
        gc.disable()  # many small lists and no cycles
        try:
            parts = [self.pieces(u) for u in coded.dictionary.to_pylist()]
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            pieces = [p for own in parts for p in own]
            del parts
            whole = [self.odd_pieces(t) if o else () for t, o in zip(texts, odd, strict=True)]
            met = list(dict.fromkeys(p for own in whole for p in own))
            strings, specials = [p for p in met if isinstance(p, str)], [p for p in met if not isinstance(p, str)]
            number = {p: len(sizes) + k for k, p in enumerate([*strings, *specials])}
        finally:
            gc.enable()
        distinct = pa.array(pieces + strings, pa.large_string()).dictionary_encode()
        which = distinct.indices.to_numpy()
        begin, data = _buffers(distinct.dictionary)
        ids, bounds = merge_pieces(self.vocab, np.frombuffer(data, np.uint8, count=int(begin[-1])), np.diff(begin))
        lengths = np.diff(bounds)[which]
        ids = np.concatenate([ids[spread(bounds[which], lengths)], np.array(specials, np.int64)])
        ends = np.concatenate([np.cumsum(sizes), len(pieces) + np.arange(1, len(strings) + 1)])
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[np.append(0, ends).astype(np.int64)]
        bounds = np.concatenate([bounds, bounds[-1] + np.arange(1, len(specials) + 1)])
        self.known = Units(ids, bounds)
        rows, plain = [], 0
        for t, o, own in zip(texts, odd, whole, strict=True):
            if o or not t:
                rows.append(np.array([number[p] for p in own], np.int64))
            else:
                rows.append(index[offsets[plain] : offsets[plain + 1]])
                plain += 1
        return rows, self.known


def gathered(batches: Iterator[pa.RecordBatch], text: str, most: int = RUN_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, small batches joined up to ``most`` bytes of text and large ones cut."""
    held, size = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            own = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
            if held and size + own > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield pa.concat_batches(held)


def stretches(column: pa.Array | list, most: int = RUN_CHARS) -> Iterator[list[str]]:
    """A column's texts, some at a time; only these are Python strings at once."""
    part, size = [], 0
    parts = [column] if isinstance(column, list) else (column.slice(k, 256).to_pylist() for k in range(0, len(column), 256))
    for t in (t or "" for some in parts for t in some):
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def decode_ids(vocab: Vocabulary, ids: list[int]) -> str:
    """The text of token ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    return b"".join([vocab.bytes_of[i] for i in ids]).decode("utf-8", errors="replace")


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with a column of token ids (an old column of that name is replaced)."""
    path, df = path or default_path(), df.drop(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in gathered(batches, text):
            lo = 0
            for part in stretches(batch.column(text)):
                rows, known = encoder.encode(part)
                units = np.concatenate(rows)
                begin, sizes = known.bounds[units], np.diff(known.bounds)[units]
                ends = np.append(0, np.cumsum(sizes))[np.cumsum([0, *map(len, rows)])]
                column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(known.ids[spread(begin, sizes)].astype(np.int32)))
                own = batch.slice(lo, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, column], names=[*own.schema.names, ids])
                lo += len(part)

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of a column of token ids; null ids give the empty text."""
    path, df = path or default_path(), df.drop(text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            out = [decode_ids(vocab, row or []) for row in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(lean(run), schema)


def round_trip_digest(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Token count, digest of the ids and digest of the text decoded from the ids, without moving ids.

    Columns of ``keep``, then n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256.
    Null and empty texts have no tokens and the digests of the empty string.
    """
    path = path or default_path()
    df = df.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([
        *(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        vocab = encoder.vocab
        for batch in gathered(batches, text):
            counts, ids_sha, text_sha = [], [], []
            for part in stretches(batch.column(text)):
                rows, known = encoder.encode(part)
                units, ends = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
                counts += np.diff(np.append(0, np.cumsum(np.diff(known.bounds)[units]))[ends]).tolist()
                data, at = known.joined(vocab.text_of, units, ends)
                ids_sha += [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in pairwise(at)]  # without the last comma
                data, at = known.joined(vocab.decoded, units, ends)
                text_sha += [hashlib.sha256(str(data[a:b], "utf-8", "replace").encode()).hexdigest() for a, b in pairwise(at)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=[f.name for f in schema.fields],
            )

    return df.mapInArrow(lean(run), schema)
