"""Token counts of a unigram tokenizer, without building tokens: a count-only Viterbi pass.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each character; dynamic
programming carries the best score and the number of pieces of the best path.  Rules, as in the
public ``tokenizers`` library (Unigram model with byte fallback behind a Metaspace splitter):

* a space becomes U+2581, one is put before the text, and the text splits before each of them;
* scores are summed in double precision; of equal scores the longest last piece stays;
* a character without a piece of its own costs the lowest score less 10; a stretch of such characters
  counts one token for each of its UTF-8 bytes.

No piece spans two splits, so each distinct word is counted once and remembered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.bpe import stretches
from lodestone.functions.memory import lean

SPACE = "▁"
#: Fixed value: the penalty of an unknown character.
UNKNOWN_PENALTY = 10.0
#: Text looked at in one go, in characters; the words remembered.
RUN_CHARS, CACHE_WORDS = 4 << 20, 200_000
#: Bytes from which a word is worked off alone: a step of all words together costs as much for one as for a thousand.
LONG_WORD = 1024


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> tuple[list[tuple[str, float]], int]:
    """The (piece, score) list of a sentencepiece file, read as a unigram vocabulary, and the unknown id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class Automaton:
    """Aho-Corasick over UTF-8 bytes with a full transition table, stepped for many words at once."""

    def __init__(self, pieces: list[tuple[bytes, float]]):
        children: list[dict[int, int]] = [{}]
        final: list[int] = [-1]
        for k, (piece, _) in enumerate(pieces):
            node = 0
            for byte in piece:
                node = children[node].setdefault(byte, len(children))
                if node == len(children):
                    children.append({})
                    final.append(-1)
            final[node] = k if piece else -1
        n = len(children)
        self.step = np.zeros((n, 256), dtype=np.int32)
        fail = np.zeros(n, dtype=np.int32)
        #: The node of the next shorter piece that also ends here, 0 if none.
        self.shorter = np.zeros(n, dtype=np.int32)
        self.piece = np.array(final, dtype=np.int32)
        for byte, child in children[0].items():
            self.step[0, byte] = child
        level = list(children[0].values())
        while level:
            following = []
            for node in level:
                up = fail[node]
                self.shorter[node] = up if final[up] >= 0 else self.shorter[up]
                self.step[node] = self.step[up]
                for byte, child in children[node].items():
                    fail[child] = self.step[up, byte]
                    self.step[node, byte] = child
                    following.append(child)
            level = following
        #: The node of the longest piece that ends at a node, 0 if none.
        self.longest = np.where(self.piece >= 0, np.arange(n), self.shorter).astype(np.int32)
        self.longest[0] = 0


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int = 0):
        self.automaton = Automaton([(p.encode(), s) for p, s in pieces])
        self.length = np.array([len(p.encode()) for p, _ in pieces], dtype=np.int64)
        self.score = np.array([s for _, s in pieces], dtype=np.float64)
        self.unknown_id = unknown_id
        self.unknown_score = float(self.score.min()) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        """Tokens of each split."""
        raw = [w.encode() for w in words]
        out = np.zeros(len(raw), dtype=np.int64)
        long = [k for k, w in enumerate(raw) if len(w) > LONG_WORD]
        for k in long:
            out[k] = self.long_word(raw[k])
        short = np.setdiff1d(np.arange(len(raw)), long)
        if len(short):
            out[short] = self.together([raw[k] for k in short.tolist()] if long else raw)
        return out

    def long_word(self, raw: bytes) -> int:
        """Tokens of one split, by the same rules as :meth:`together`."""
        auto, n = self.automaton, len(raw)
        longest, shorter, piece_of, length, score = (memoryview(x) for x in (auto.longest, auto.shorter, auto.piece, self.length, self.score))
        step, node, seen = memoryview(auto.step.reshape(-1)), 0, 0
        best, count, run, literal = [-math.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        for t, byte in enumerate(raw):
            node = step[256 * node + byte]
            seen = seen + 1 if byte & 0xC0 == 0x80 else 1
            here, at, single = t + 1, longest[node], False
            while at > 0:
                piece = piece_of[at]
                size = length[piece]
                single |= size == seen
                start = here - size
                offer = best[start] + score[piece]
                if offer > best[here]:
                    best[here] = offer
                    if piece == self.unknown_id:
                        count[here], literal[here], run[here] = count[start], run[start] == 0, run[start] + size
                    else:
                        count[here], literal[here], run[here] = count[start] + (1 if literal[start] else run[start]) + 1, False, 0
                at = shorter[at]
            if not single and (here == n or raw[here] & 0xC0 != 0x80):  # whole characters end here
                start = here - seen
                offer = best[start] + self.unknown_score
                if offer > best[here]:
                    best[here], count[here], literal[here], run[here] = offer, count[start], False, run[start] + seen
        return count[n] + (1 if literal[n] else run[n])

    def together(self, raw: list[bytes]) -> np.ndarray:
        """Tokens of each split; all advance one byte at a time together."""
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        order = np.argsort(-sizes, kind="stable")
        raw = [raw[k] for k in order.tolist()]
        sizes = sizes[order]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        byte_at = np.cumsum(sizes) - sizes
        state_at = byte_at + np.arange(len(raw))  # one state more than bytes for each word
        total = len(data) + len(raw)
        best = np.full(total, -np.inf)
        best[state_at] = 0.0
        # tokens before an open run of unknown characters, bytes of that run, and whether it is the unknown piece itself
        count, run, literal = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
        node = np.zeros(len(raw), dtype=np.int32)
        seen = np.zeros(len(raw), dtype=np.int64)  # bytes of the current character
        auto = self.automaton
        for t in range(int(sizes[0])):
            m = int(np.searchsorted(-sizes, -t, side="left"))  # words longer than t
            byte = data[byte_at[:m] + t]
            node = auto.step[node[:m], byte]
            seen = np.where((byte & 0xC0) == 0x80, seen[:m] + 1, 1)
            here = state_at[:m] + t + 1
            single = np.zeros(m, dtype=bool)
            rows, at = np.arange(m), auto.longest[node]
            while True:
                keep = at > 0
                if not keep.all():
                    rows, at = rows[keep], at[keep]
                if not len(rows):
                    break
                piece = auto.piece[at]
                size = self.length[piece]
                single[rows] |= size == seen[rows]
                self._advance(best, count, run, literal, here[rows], size, self.score[piece], piece == self.unknown_id)
                at = auto.shorter[at]
            ends = np.ones(m, dtype=bool)  # whole characters end here
            inner = sizes[:m] > t + 1
            ends[inner] = (data[byte_at[:m][inner] + t + 1] & 0xC0) != 0x80
            lone = np.flatnonzero(ends & ~single)
            if len(lone):
                self._advance(best, count, run, literal, here[lone], seen[lone], self.unknown_score, None)
        out = np.empty(len(raw), dtype=np.int64)
        last = state_at + sizes
        out[order] = count[last] + np.where(literal[last], 1, run[last])
        return out

    @staticmethod
    def _advance(best, count, run, literal, here, size, score, unknown) -> None:
        """Offer a last piece to some states; only a higher score replaces what is there."""
        start = here - size
        offer = best[start] + score
        wins = offer > best[here]
        if not wins.all():
            here, start, offer = here[wins], start[wins], offer[wins]
        best[here] = offer
        open_run = run[start]
        if unknown is None or unknown.any():
            is_unknown = np.ones(len(here), bool) if unknown is None else unknown[wins]
            own = size[wins]
        else:
            is_unknown, own = None, None
        closed = count[start] + np.where(literal[start], 1, open_run) + 1
        if is_unknown is None:
            count[here], run[here], literal[here] = closed, 0, False
        else:
            count[here] = np.where(is_unknown, count[start], closed)
            run[here] = np.where(is_unknown, open_run + own, 0)
            literal[here] = is_unknown & (open_run == 0) & (unknown is not None)

    def texts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; texts without a character have none."""
        rows = []
        for text in texts:
            text = (text or "").replace(" ", SPACE)
            rows.append(text.split(SPACE)[0 if not text.startswith(SPACE) else 1 :] if text else [])
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        fresh = list(set().union(*rows).difference(known))
        known.update(zip(fresh, self.words([SPACE + w for w in fresh]).tolist(), strict=True))
        return [sum([known[w] for w in row]) for row in rows]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(*load_pieces(path))


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` without its text, with the token count of every whole text; null and empty texts count 0.

    A column of ``df`` named as ``out`` is replaced.
    """
    path, keep = path or default_path(), [c for c in df.columns if c not in (text, out)]
    df = df.select(*keep, text)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).texts
        for batch in batches:
            counts = pa.array([n for part in stretches(batch.column(text), RUN_CHARS) for n in count(part)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), counts], names=[*keep, out])

    return df.mapInArrow(lean(run), schema)
