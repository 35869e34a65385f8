"""Functions that run a state machine over one text: comment blanking, chunking, the FNV hash.

They work on Arrow batches; everything else of the engine stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.memory import give_back

#: One alternation, first branch first: raw strings, strings, line comments, block comments.
_RUST_HIDDEN = re.compile(r'r(?P<h>#*)"(?P<raw>.*?)"(?P=h)|"(?P<str>(?:\\.|[^"\\])*)"?|//(?P<line>[^\n]*)|/\*(?P<block>.*?)(?:\*/|\Z)', re.S)


def blank_rust(source: str) -> str:
    """Rust source with the contents of strings and comments blanked; line feeds and length in characters stay.

    Block comments do not nest, and a double quote within a character literal opens a string.
    """

    def blanked(m: re.Match) -> str:
        kind = m.lastgroup
        if kind is None:
            return m[0]
        lo, hi = m.span(kind)
        keep = m.start()
        return m[0][: lo - keep] + re.sub(r"[^\n]", " ", m[0][lo - keep : hi - keep]) + m[0][hi - keep :]

    return _RUST_HIDDEN.sub(blanked, source)


def _blank_batch(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else blank_rust(s))


def blank_rust_source(source: Column) -> Column:
    return F.pandas_udf(_blank_batch, T.StringType())(source)


#: Estimated tokens of a chunk, aimed at and at most.
TARGET_TOKENS, MAX_TOKENS = 512, 1024


def _size(text: str) -> int:
    return len(text.encode()) // 4


def _paragraphs(content: str) -> Iterator[tuple[int, int]]:
    """Character spans of the trimmed paragraphs between empty lines."""
    at = 0
    for piece in content.split("\n\n"):
        body = piece.strip()
        if body:
            lo = at + (len(piece) - len(piece.lstrip()))
            yield lo, lo + len(body)
        at += len(piece) + 2


def _line_spans(content: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """A long paragraph, cut before the line that would exceed the most; one line is never cut."""
    begin = end = None
    at = lo
    for line in content[lo:hi].split("\n"):
        stop = at + len(line)
        if begin is not None and _size(content[begin:end]) + _size(line) > MAX_TOKENS:
            yield begin, end
            begin = None
        if begin is None:
            begin = at
        end = stop
        at = stop + 1
    if begin is not None and content[begin:end].strip():
        yield begin, end


def chunk_spans(content: str) -> list[tuple[int, int]]:
    """Character spans of the chunks of a text: whole if short, else paragraphs merged to a target size."""
    if not content:
        return []
    if _size(content) <= MAX_TOKENS:
        return [(0, len(content))]
    out: list[tuple[int, int]] = []
    open_span: tuple[int, int] | None = None
    for lo, hi in _paragraphs(content):
        size = _size(content[lo:hi])
        if open_span and _size(content[slice(*open_span)]) + size > MAX_TOKENS:
            out.append(open_span)
            open_span = None
        if size > MAX_TOKENS:
            out += _line_spans(content, lo, hi)
            continue
        open_span = (open_span[0], hi) if open_span else (lo, hi)
        if _size(content[slice(*open_span)]) >= TARGET_TOKENS:
            out.append(open_span)
            open_span = None
    return out + ([open_span] if open_span else [])


SPANS = T.ArrayType(T.StructType([T.StructField("off", T.LongType()), T.StructField("len", T.LongType())]))


def _span_batch(content: pa.Array) -> pa.Array:
    """Byte spans of the chunks of some texts, of which one at a time is taken out of the batch."""
    ends, spans = [0], []
    for scalar in content:
        text, at, byte = scalar.as_py() or "", 0, 0
        for lo, hi in chunk_spans(text):
            byte += len(text[at:lo].encode())
            size = len(text[lo:hi].encode())
            spans += (byte, size)
            at, byte = hi, byte + size
        ends.append(len(spans) // 2)
    pairs = np.array(spans, dtype=np.int64).reshape(-1, 2)
    both = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["off", "len"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)


def chunk_bytes(content: Column) -> Column:
    """Byte spans (off, len) of the chunks of each text.  Only texts of several chunks pass through Python."""

    @F.arrow_udf(SPANS)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield _span_batch(texts)
        finally:
            give_back()

    size = F.octet_length(content)
    short = size < 4 * (MAX_TOKENS + 1)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("off"), size.cast("long").alias("len")))
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.array().cast(SPANS)).when(short, whole).otherwise(cut(F.when(~short, content)))


def chunks(content: Column) -> Column:
    """Chunks of each text with byte offsets into it: text equals the bytes [off, off + len)."""
    text = lambda s: F.decode(F.substring(F.encode(content, "UTF-8"), (s["off"] + 1).cast("int"), s["len"].cast("int")), "UTF-8")
    return F.transform(chunk_bytes(content), lambda s: F.struct(text(s).alias("text"), s["off"].alias("off"), s["len"].alias("len")))


#: Tokens that are told apart in one step.
TOKENS_TOGETHER, TOKEN_ROWS = 1 << 19, 1 << 16


def _token_rows(names: pa.Array, lists: pa.Array, field: str) -> pa.RecordBatch:
    """Of some documents' lists of tokens: each token of each document, in the order of tokens, with its positions."""
    flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    words = flat.dictionary_encode()
    turn = np.empty(len(words.dictionary), dtype=np.int64)  # words are sorted, so that the table's sort meets long runs
    turn[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(turn))
    code = words.indices.to_numpy(zero_copy_only=False)
    key = turn[code] * len(sizes) + owner
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(first, len(key)).astype(np.int32)
    columns = [
        pa.repeat(field, len(first)), words.dictionary.take(pa.array(code[order[first]])), names.take(pa.array(owner[order[first]])),
        pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["field", "token", "relative_path", "tf", "positions"])


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """field, token, relative_path, tf, positions of batches of relative_path and a list of tokens for each field."""
    for batch in batches:
        names = batch.column(0)
        for k, field in enumerate(batch.schema.names[1:], 1):
            lists, at = batch.column(k), 0
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < len(names):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS_TOGETHER, side="right")))
                rows = _token_rows(names[at:stop], lists[at:stop], field)
                for lo in range(0, rows.num_rows, TOKEN_ROWS):
                    yield rows.slice(lo, TOKEN_ROWS)
                at = stop


#: Offset and prime of FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
#: Texts that are stepped together; the rest of fewer ones is worked off one by one.
FNV_TOGETHER = 32


PARAGRAPHS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("off", T.LongType())]))
#: Fixed value: the characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def paragraph_rows(content: str) -> list[dict]:
    """What stands between empty lines, trimmed, with the byte at which it began before it was trimmed; none is empty."""
    out, at = [], 0
    for piece in content.split("\n\n"):
        if body := piece.strip(WHITE):
            out.append({"text": body, "off": at})
        at += len(piece.encode()) + 2
    return out


def _paragraph_batch(content: pd.Series) -> pd.Series:
    return content.map(lambda s: paragraph_rows(s or ""))


def paragraphs(content: Column) -> Column:
    """Paragraphs of each text (text, off)."""
    return F.pandas_udf(_paragraph_batch, PARAGRAPHS)(content)


def fnv1a(data: bytes, h: int = FNV_OFFSET) -> int:
    """FNV-1a of some bytes, or of what follows bytes whose hash is ``h``."""
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_of(texts: list[bytes]) -> list[int]:
    """FNV-1a of each text: the k-th bytes of all that are long enough are taken in one step."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) for k in order], dtype=np.int64)
    data = np.frombuffer(b"".join(texts[k] for k in order), dtype=np.uint8)
    at = np.cumsum(sizes) - sizes
    h = np.full(len(texts), FNV_OFFSET, dtype=np.uint64)
    together = int(sizes[FNV_TOGETHER - 1]) if len(texts) >= FNV_TOGETHER else 0
    many = len(texts) - np.searchsorted(sizes[::-1], np.arange(together), side="right")
    for k, n in enumerate(many.tolist()):
        h[:n] = (h[:n] ^ data[at[:n] + k]) * np.uint64(FNV_PRIME)
    out = [0] * len(texts)
    for row, k in enumerate(order):
        out[k] = fnv1a(texts[k][together:], int(h[row])) if len(texts[k]) > together else int(h[row])
    return out


def _fnv_batch(content: pd.Series) -> pd.Series:
    known = content[content.notna()]
    return pd.Series([f"{h:016x}" for h in fnv1a_of([s.encode() for s in known])], index=known.index, dtype=object).reindex(content.index)


def fnv1a_hex(content: Column) -> Column:
    """For exchange with tools that store this hash; the engine itself compares SHA-256."""
    return F.pandas_udf(_fnv_batch, T.StringType())(content)
