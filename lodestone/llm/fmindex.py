"""A compressed FM-index over integer sequences: bit-packed wavelet matrix, searched backwards.

The suffixes are sorted by their first ``order`` symbols only (doubling), which is all that patterns of
at most that length need, and by their starts where these are equal.  Many patterns are searched at once: each step is a few NumPy gathers over all
that are still open.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


class WaveletMatrix:
    """rank(symbol, position) over a sequence, one packed bit plane for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), max(1, int(sigma - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(_U)
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))[:-1]]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        every = np.arange(sigma)
        self.base = self._descend(every, np.zeros(sigma, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = (_U(1) << (at & 63).astype(_U)) - _U(1)
            rank = self.ones[k][word] + np.bitwise_count(self.words[k][word] & below)
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            at = np.where(one, rank + self.zeros[k], at - rank)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, at) - self.base[symbol]


def sort_suffixes(symbols: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix starts by their first ``order`` symbols (ties by position), and where a new such prefix begins."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    ranks, have = {1: rank + 1}, 1

    def joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        tail = np.zeros(n, dtype=np.int64)
        if shift < n:
            tail[: n - shift] = b[shift:]
        _, out = np.unique(a.astype(np.int64) * (n + 2) + tail, return_inverse=True)
        return out + 1

    while have < order:
        step = have if 2 * have <= order else max(k for k in ranks if k <= order - have)
        ranks[have + step] = joined(ranks[have], ranks[step], have)
        have += step
        if int(ranks[have].max()) == n:
            break
    suffixes = np.argsort(ranks[have], kind="stable")
    rank = ranks[have][suffixes]
    return suffixes, np.append(True, rank[1:] != rank[:-1])


class FMIndex:
    """The index of a sequence whose last symbol is 0; patterns hold no 0.

    Kept are the wavelet matrix of the last column, and a sample of the suffix starts: that of the first row of
    each interval of ``order`` symbols that has several rows, under a bit vector with ranks.  Neither the
    sequence nor its suffix array stays.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, order: int):
        self.n, self.sigma = len(symbols), sigma
        suffixes, begins = sort_suffixes(symbols, order)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.wavelet = WaveletMatrix(symbols[suffixes - 1], sigma)
        sampled = begins & ~np.append(begins[1:], True)
        packed = np.packbits(sampled, bitorder="little")
        self.marks = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(_U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks))[:-1]]).astype(np.int32)
        self.samples = suffixes[sampled].astype(np.int32)

    def earliest(self, lo: np.ndarray) -> np.ndarray:
        """The least start in each interval of ``order`` symbols that begins at row ``lo`` and has several rows."""
        word, bit = lo >> 6, (lo & 63).astype(_U)
        return self.samples[self.before[word] + np.bitwise_count(self.marks[word] & ((_U(1) << bit) - _U(1)))].astype(np.int64)

    def matches(self, symbols: np.ndarray, ends: np.ndarray, length: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the stretches of ``symbols`` that end before ``ends``.

        Each stretch is extended to the left, symbol by symbol, while at least ``least`` suffixes begin
        with it, up to ``length``.  Returns how far each came and the suffix interval [lo, hi) reached.
        """
        m = len(ends)
        lo, hi, far = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.zeros(m, np.int64)
        open_rows = np.arange(m)
        for step in range(1, length + 1):
            c = symbols[ends[open_rows] - step]
            k = len(open_rows)
            if step == 1:
                new_lo, new_hi = self.less[c], self.less[c + 1]
            else:
                ranks = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[open_rows], hi[open_rows]]))
                new_lo, new_hi = self.less[c] + ranks[:k], self.less[c] + ranks[k:]
            goes_on = new_hi - new_lo >= least
            open_rows = open_rows[goes_on]
            lo[open_rows], hi[open_rows] = new_lo[goes_on], new_hi[goes_on]
            far[open_rows] = step
            if not len(open_rows):
                break
        return far, lo, hi
