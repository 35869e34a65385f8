"""WARC archives and their chunked record table.

Writing: one record a page, uncompressed inside or gzip by record; payloads are streamed in chunks.
Of records with equal payloads of at least 1000 bytes only the one with the largest id holds the
payload (``response``), the others refer to it (``revisit``).  Reading: an archive is parsed as a
stream of bounded buffers into rows (record_id, chunk_no, data, bytes and SHA-1 so far); no record is
ever held whole, so a payload may be larger than memory.  The row flagged ``is_last`` carries the
totals of its record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import new_file, open_input, open_output

CHUNK_BYTES, ARCHIVE_BYTES, REVISIT_BYTES = 256 << 10, 64 << 20, 1000
#: Fixed values of the format.
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CHUNK_SCHEMA = (
    "archive string, record_id string, page_id long, record_type string, refers_to long, target_uri string, declared_digest string, "
    "chunk_no long, is_last boolean, data binary, n_bytes long, bytes_so_far long, sha1_so_far string"
)


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, record_type and refers_to of every page; null html is the empty payload.

    Digests are compared, not payloads, and travel without the text.  A hot digest is aggregated
    before the shuffle; its rows meet the one winner in a join that AQE can split.  A row is told by its
    id and its digest, so rows that repeat an id are judged each by its own payload, and every row of
    ``pages`` gives one record.  A null id is smaller than any other: such a row revisits a record with an
    id, and never is referred to; equal payloads without any id are all responses.  Of rows that repeat both
    the keeper's id and its payload each is a response.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digests = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("n"))
    large = digests.where(F.col("n") >= REVISIT_BYTES)
    winners = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and keeper is not null")
    later = F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper"))
    revisits = large.join(winners.select("digest", "keeper"), "digest").where(later)
    # one row an id and digest; a null id joins as any other value
    revisits = revisits.groupBy(F.col("page_id").alias("id"), F.col("digest").alias("own")).agg(F.max("keeper").alias("refers_to"))
    own = F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha1(F.encode("html", "UTF-8")))
    return (
        pages.withColumn("digest", own)
        .join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("own")), "left")
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
        .select("page_id", "url", "html", "record_type", "refers_to")
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


class _Sink:
    """Writes through gzip, one member a record, or plainly."""

    def __init__(self, out, gzip: bool):
        self.out, self.gzip, self.at, self.deflate = out, gzip, 0, None

    def begin(self) -> None:
        self.deflate = zlib.compressobj(6, zlib.DEFLATED, 31) if self.gzip else None

    def write(self, data: bytes) -> None:
        data = self.deflate.compress(data) if self.deflate else data
        self.out.write(data)
        self.at += len(data)

    def end(self) -> None:
        if self.deflate:
            data = self.deflate.flush()
            self.out.write(data)
            self.at += len(data)


def write_record(sink: _Sink, page_id: int | None, url: str | None, payload: memoryview, kind: str, refers_to: int | None) -> None:
    sha = hashlib.sha1()
    for lo in range(0, len(payload), CHUNK_BYTES):
        sha.update(payload[lo : lo + CHUNK_BYTES])
    digest = "sha1:" + base64.b32encode(sha.digest()).decode()
    body = _HTTP if kind == "response" else b""
    url = "".join((url or "").split())
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {digest}", f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(body) + (len(payload) if kind == 'response' else 0)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_REVISIT_PROFILE}"]
    sink.begin()
    sink.write("\r\n".join([*head, "", ""]).encode() + body)
    if kind == "response":
        for lo in range(0, len(payload), CHUNK_BYTES):
            sink.write(payload[lo : lo + CHUNK_BYTES])
    sink.write(b"\r\n\r\n")
    sink.end()


def write_archives(records: DataFrame, folder: str, gzip: bool = True) -> DataFrame:
    """Write (page_id, url, html, record_type, refers_to) rows; returns the (archive, records) rows, not yet run."""
    records = records.select("page_id", "url", "html", "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, made, n = None, [], 0
        for batch in batches:
            for page_id, url, html, kind, refers in zip(*batch.columns, strict=True):
                if sink is None:
                    uri, n = new_file(folder, ".warc.gz" if gzip else ".warc"), 0
                    sink = _Sink(open_output(uri), gzip)
                payload = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                write_record(sink, page_id.as_py(), url.as_py(), payload, kind.as_py(), refers.as_py())
                n += 1
                if sink.at >= ARCHIVE_BYTES:
                    sink.out.close()
                    made.append((uri, n))
                    sink = None
        if sink is not None:
            sink.out.close()
            made.append((uri, n))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["archive", "records"])

    return records.mapInArrow(run, "archive string, records long")


class _Stream:
    """Bytes of an archive, inflated where they are gzip members, through a bounded buffer."""

    def __init__(self, file):
        self.file, self.buffer, self.inflate, self.raw, self.plain = file, b"", None, b"", None

    def _fill(self) -> bool:
        if self.plain is None:
            self.raw = self.file.read(CHUNK_BYTES)
            self.plain = self.raw[:2] != b"\x1f\x8b"
        while True:
            if self.plain:
                data, self.raw = self.raw or self.file.read(CHUNK_BYTES), b""
                self.buffer += data
                return bool(data)
            if self.inflate is None or self.inflate.eof:
                rest = self.inflate.unused_data if self.inflate else self.raw
                rest = rest or self.file.read(CHUNK_BYTES)
                if not rest:
                    return False
                self.inflate, self.raw = zlib.decompressobj(31), rest
            data = self.inflate.decompress(self.raw, CHUNK_BYTES)
            self.raw = self.inflate.unconsumed_tail
            if not self.raw and not self.inflate.eof and not data:
                self.raw = self.file.read(CHUNK_BYTES)
                if not self.raw:
                    raise ValueError("an archive ends within a record")
                continue
            if data:
                self.buffer += data
                return True

    def line(self) -> bytes | None:
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self._fill():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + 2 :]
        return out

    def some(self, most: int) -> bytes:
        """At least one byte and at most ``most``."""
        if not self.buffer and not self._fill():
            raise ValueError("an archive ends within a record")
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out


def _page(ref: str | None) -> int | None:
    tail = (ref or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def parse(file, archive: str, with_data: bool = True) -> Iterator[dict]:
    """Chunk rows of one archive."""
    stream = _Stream(file)
    while (version := stream.line()) is not None:
        if not version:
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no record begins here")
        head: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", errors="replace").partition(":")
            head[name.lower()] = value.strip()
        left, kind = int(head["content-length"]), head["warc-type"]
        declared = head.get("warc-payload-digest", "").rpartition(":")[2]
        base = {
            "archive": archive, "record_id": head["warc-record-id"], "page_id": _page(head["warc-record-id"]), "record_type": kind,
            "refers_to": _page(head.get("warc-refers-to")), "target_uri": head.get("warc-target-uri"),
            "declared_digest": base64.b32decode(declared).hex() if declared else None,
        }
        if kind == "response":  # the HTTP head comes before the payload
            while line := stream.line():
                left -= len(line) + 2
            left -= 2
        sha, done, number = hashlib.sha1(), 0, 0
        while True:
            chunk = b""
            while len(chunk) < min(CHUNK_BYTES, left):
                chunk += stream.some(min(CHUNK_BYTES, left) - len(chunk))
            left -= len(chunk)
            sha.update(chunk)
            done += len(chunk)
            last = left == 0
            row = {**base, "chunk_no": number, "is_last": last, "data": chunk if with_data else None, "n_bytes": len(chunk), "bytes_so_far": done, "sha1_so_far": sha.hexdigest()}
            if kind == "revisit":
                row |= {"bytes_so_far": int(head.get("x-payload-length", 0)), "sha1_so_far": base["declared_digest"]}
            yield row
            number += 1
            if last:
                break


def read_archives(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``manifest`` (column archive), a task per few archives."""
    kinds = pa.schema([
        ("archive", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("target_uri", pa.string()), ("declared_digest", pa.string()), ("chunk_no", pa.int64()), ("is_last", pa.bool_()), ("data", pa.binary()),
        ("n_bytes", pa.int64()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_input(archive) as file:
                    for row in parse(file, archive, with_data):
                        rows.append(row)
                        held += row["n_bytes"] if with_data else 256
                        if held >= 16 * CHUNK_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("archive").repartition(tasks).mapInArrow(run, CHUNK_SCHEMA)


def record_digest(chunks: DataFrame) -> DataFrame:
    """One row a record: its totals, from its last chunk; a mismatch with the declared digest fails the query."""
    bad = F.col("declared_digest") != F.col("sha1_so_far")
    return chunks.where("is_last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"),
        F.when(bad, F.raise_error(F.concat(F.lit("payload digest differs: "), "record_id"))).otherwise(F.col("sha1_so_far")).alias("payload_digest"),
        "record_type", "refers_to", (F.col("chunk_no") + 1).alias("n_chunks"),
    )
