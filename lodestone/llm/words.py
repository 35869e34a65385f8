"""Words, word hashes and word n-gram hashes of whole Arrow string batches, in NumPy.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return.  These six are ASCII, so the UTF-8 bytes can be split without decoding.  Hashes are
64 bits wide; a batch is worked through in blocks of half a MB, so memory follows the block and the
longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
#: For loose comparison: every ASCII byte that is no letter or digit separates.
LOOSE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _byte_codes(fold: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
    if fold:
        codes[65:91] = codes[97:123]
    return codes


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_CODES = {False: _byte_codes(False), True: _byte_codes(True)}
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        out = np.empty(size, dtype=_U)
        out[0] = 1
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            out[filled : filled + step] = out[:step] * _U(pow(base, filled, 1 << 64))
            filled += step
        if size > (1 << 19):  # a long text: not kept
            return out
        _powers[base] = have = out
    return have


@dataclass
class Words:
    """The words of some consecutive texts: byte spans in ``data``, and each text's range of words."""

    first_row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # text i has words bounds[i]:bounds[i+1]
    text_bounds: np.ndarray  # and bytes text_bounds[i]:text_bounds[i+1]

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def hashes(self, fold: bool = False) -> np.ndarray:
        """One 64-bit hash a word; ``fold`` hashes A-Z as a-z."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, dtype=_U)
        total = np.empty(n + 1, dtype=_U)
        total[0] = 0
        np.cumsum(_CODES[fold][self.data] * _powers_of(_BASE, n)[:n], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * _powers_of(_BASE_INV, n)[self.starts]
        return mix(h ^ ((self.ends - self.starts).astype(_U) << _U(48)))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, max_bytes: int = 1 << 19, separators: np.ndarray = _IS_SEP) -> Iterator[Words]:
    """The words of a column of texts, half a MB of whole texts at a time."""
    data, offsets = utf8(column)
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), rows)
        begin, end = int(offsets[lo]), int(offsets[hi])
        part, bounds = data[begin:end], offsets[lo : hi + 1] - begin
        yield split(part, bounds, lo, separators)
        lo = hi


def split(data: np.ndarray, text_bounds: np.ndarray, first_row: int = 0, separators: np.ndarray = _IS_SEP) -> Words:
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~separators[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    cuts = text_bounds[(text_bounds > 0) & (text_bounds < n)]
    opens[cuts] |= inside[1:-1][cuts]
    closes[cuts - 1] |= inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(first_row, data, starts, ends, np.searchsorted(starts, text_bounds), text_bounds)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of word hashes, one for each start."""
    if len(h) < n:
        return np.zeros(0, dtype=_U)
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out = out * _U(0xA24BAED4963EE407) + h[k : k + m]
    return mix(out + _U(n))


def stretches_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each stretch [start, end) of a sequence of word hashes."""
    total = np.zeros(len(h) + 1, dtype=_U)
    np.cumsum(h * _powers_of(_BASE, len(h))[: len(h)], out=total[1:])
    return mix((total[ends] - total[starts]) * _powers_of(_BASE_INV, len(h) + 1)[starts] + (ends - starts).astype(_U))


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of one text; a shorter text is one shingle; no words, none."""
    if not len(h):
        return h
    return np.unique(ngrams(h, n)) if len(h) >= n else ngrams(h, len(h))
