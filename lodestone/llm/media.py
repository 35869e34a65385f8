"""Media columns: byte payloads stored as lossless images in archives, and read back as rows.

Writing: every payload becomes a PNG of 8-bit RGB samples, 64 pixels (192 bytes) wide; the images of a
task go, one after another, into ZIP archives of bounded size.  Reading: a Spark data source over the
archives plans byte ranges from file sizes alone; each task reads the central directories it needs, takes the
members whose offset lies in its range, and streams them as Arrow batches.  A member that fails to
read is tried again from its own offset, with the archive opened anew; others are not read again.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.llm.store import new_file, open_input, open_output

ROW_BYTES, PIXELS = 192, 64
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 32 << 20, 8 << 20, 4 << 20
TRIES = 4

# --- PNG -------------------------------------------------------------------------------------------

#: Fixed values of the format.
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(payload: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return payload.ljust(max(1, -(-len(payload) // ROW_BYTES)) * ROW_BYTES, b" ")


def to_png(payload: bytes) -> bytes:
    """A 64 pixels wide RGB image whose samples are the payload, a multiple of 192 bytes."""
    rows = len(payload) // ROW_BYTES
    lines = np.zeros((rows, ROW_BYTES + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, ROW_BYTES)
    head = struct.pack(">IIBBBBB", PIXELS, rows, 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> np.ndarray:
    """The samples of such an image, rows by 192; raises ValueError for anything damaged or different."""
    if image[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, shape = 8, [], None
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if shape is None or shape[0] != PIXELS or shape[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not the stored format")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(shape[1], ROW_BYTES + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return lines[:, 1:]


# --- ZIP: members stored as they are, offsets in 64 bits where needed --------------------------------


class ArchiveWriter:
    """A ZIP archive written in one forward pass; only the directory entries are held."""

    def __init__(self, uri: str):
        self.uri, self.out, self.at, self.entries = uri, open_output(uri), 0, []

    def add(self, name: str, body: bytes) -> None:
        raw = name.encode()
        crc = zlib.crc32(body)
        head = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20)
        extra = struct.pack("<HHQQ", 1, 16, len(body), len(body))
        self.entries.append((raw, crc, len(body), self.at))
        self.out.write(head + raw + extra + body)
        self.at += len(head) + len(raw) + len(extra) + len(body)

    def close(self) -> int:
        begin = self.at
        for raw, crc, size, at in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            head = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
            self.out.write(head + raw + extra)
            self.at += len(head) + len(raw) + len(extra)
        n, size = len(self.entries), self.at - begin
        self.out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, begin))
        self.out.write(struct.pack("<IIQI", 0x07064B50, 0, self.at, 1))
        self.out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        self.out.close()
        return self.at + 56 + 20 + 22


def directory(file, size: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, crc, size, offset) of each member, from the central directory at the end."""
    file.seek(size - 98)
    tail = file.read(98)
    if tail[:4] != b"PK\x06\x06":
        raise ValueError("no archive written by ArchiveWriter")
    n, length, begin = struct.unpack_from("<QQQ", tail, 32)
    file.seek(begin)
    body = file.read(length)
    at = 0
    for _ in range(n):
        crc, name_len, extra_len = struct.unpack_from("<16xI8xHH", body, at)
        name = body[at + 46 : at + 46 + name_len].decode()
        member, _, offset = struct.unpack_from("<QQQ", body, at + 46 + name_len + 4)
        yield name, crc, member, offset
        at += 46 + name_len + extra_len


def read_member(file, crc: int, size: int, offset: int) -> bytes:
    file.seek(offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member here")
    name_len, extra_len = struct.unpack_from("<26xHH", head)
    file.seek(offset + 30 + name_len + extra_len)
    body = file.read(size)
    if len(body) != size or zlib.crc32(body) != crc:
        raise ValueError("damaged member")
    return body


def retried(open_file: Callable, file, crc: int, size: int, offset: int):
    """One member, tried again from its own offset with a new handle; returns the body and the handle."""
    for attempt in range(TRIES):
        try:
            return read_member(file, crc, size, offset), file
        except (OSError, ValueError):
            if attempt == TRIES - 1:
                raise
            time.sleep(0.05 * 4**attempt)
            file = open_file()
    raise AssertionError


# --- Writing ---------------------------------------------------------------------------------------


def write_archives(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store the texts of ``df`` below ``folder``; returns the (archive, bytes) rows, not yet run.

    A member's name is its number within the archive, the payload's bytes without padding, and the key.
    Null keys and null or empty texts are stored too.
    """
    df = df.select(df[key].cast("string").alias("key"), df[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, made, n = None, [], 0
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                if writer is None:
                    writer, n = ArchiveWriter(new_file(folder, ".zip")), 0
                k, payload = k.as_py(), (t.as_py() or "").encode()
                writer.add(f"{n}-{len(payload)}-{'' if k is None else k}.png", to_png(pad(payload)))
                n += 1
                if writer.at >= ARCHIVE_BYTES:
                    made.append((writer.uri, writer.close()))
                    writer = None
        if writer is not None:
            made.append((writer.uri, writer.close()))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in made], pa.string()), pa.array([b for _, b in made], pa.int64())], names=["archive", "bytes"])

    return df.mapInArrow(run, "archive string, bytes long")


# --- The data source -------------------------------------------------------------------------------

MEDIA_SCHEMA = "key string, n_bytes long, media binary"


class ByteRange(InputPartition):
    def __init__(self, archives: list[tuple[str, int, int, int]]):
        self.archives = archives  # uri, file size, first byte, byte after the last


class MediaSource(DataSource):
    """``spark.read.format("media_archive")``; option ``manifest`` holds "uri\\tsize" lines, one an archive,
    and option ``manifest_file`` names a file of such lines."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEDIA_SCHEMA

    def reader(self, schema: T.StructType) -> MediaReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        held = options.get("manifest", "")
        if where := options.get("manifest_file"):
            with open_input(where) as file:
                held = file.read().decode()
        lines = [x.rsplit("\t", 1) for x in held.split("\n") if x]
        self.files = [(uri, int(size)) for uri, size in lines]
        self.range = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        """Byte ranges from file sizes alone; small archives share a task."""
        out, part, filled = [], [], 0
        for uri, size in self.files:
            for lo in range(0, size, self.range):
                hi = min(lo + self.range, size)
                part.append((uri, size, lo, hi))
                filled += hi - lo
                if filled >= self.range:
                    out.append(ByteRange(part))
                    part, filled = [], 0
        return out + ([ByteRange(part)] if part else []) or [ByteRange([])]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        keys, sizes, media, held = [], [], [], 0
        for uri, size, lo, hi in partition.archives:
            def again(uri: str = uri):
                return open_input(uri)

            file = again()
            for name, crc, length, offset in directory(file, size):
                if not lo <= offset < hi:
                    continue
                body, file = retried(again, file, crc, length, offset)
                _, n_bytes, key = name.removesuffix(".png").split("-", 2)
                keys.append(key if key else None)
                sizes.append(int(n_bytes))
                media.append(body)
                held += length
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema=schema)
                    keys, sizes, media, held = [], [], [], 0
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema=schema)


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """key, n_bytes, media of every member.  The manifest is a row for each archive of tens of MB."""
    spark.dataSource.register(MediaSource)
    source, out, where = spark.read.format("media_archive"), None, None
    for r in manifest.orderBy("archive").toLocalIterator():
        if out is None:
            where = new_file(r.archive.rpartition("/")[0], ".manifest")
            out = open_output(where)
        out.write(f"{r.archive}\t{r.bytes}\n".encode())
    if out is not None:
        out.close()
        source = source.option("manifest_file", where)
    return source.load()


# --- Features --------------------------------------------------------------------------------------


def describe(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy and a 64-bit average hash of the image's samples."""
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256)
    p = counts[counts > 0] / len(flat)
    mean = float(flat.mean())
    cells = np.array([part.mean() for part in np.array_split(flat, 64)])
    bits = int("".join("1" if c > mean else "0" for c in cells), 2)
    return f"{PIXELS}x{len(samples)};mean={mean:.4f};std={float(flat.std()):.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};ahash={bits:016x}"


def media_digest(media: DataFrame) -> DataFrame:
    """Digests and features of the images of :func:`read_archives`, all from the bytes read back."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, image in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                samples = from_png(image)
                raw = samples.tobytes()
                rows.append((key and int(key), n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(image), hashlib.sha256(image).hexdigest(), describe(samples)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
