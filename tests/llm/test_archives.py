"""WARC archives and media archives: exact round trips, damage and retries."""

import gzip
import hashlib
import io
import zipfile
import zlib

import numpy as np
import pytest

from lodestone.llm import media, store, warc
from lodestone.runtime import Scratch


def pages():
    big = "<p>" + "é&" * 400 + "</p>"
    huge = "z" * (3 * warc.CHUNK_BYTES + 17)
    return [(1, "http://a/1", big), (2, "http://a/2 x\r\ny", big), (3, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", huge), (9, "u", "a" * 999), (10, "u", "a" * 999), (11, "u", "b" * 1000), (12, "u", "b" * 1000), (None, "u", "c" * 2000)]


@pytest.mark.parametrize("packed", [True, False])
def test_warc_round_trip(spark, packed):
    rows = pages()
    df = spark.createDataFrame([(p, u, h, "x") for p, u, h in rows], "page_id long, url string, html string, record_type string").repartition(3)
    scratch = Scratch(spark, "test-warc")
    manifest = scratch.table(warc.write_archives(warc.plan_records(df), f"{scratch.path}/archives", packed), "manifest")
    chunks = warc.read_archives(manifest).persist()
    got = {r.page_id: r for r in warc.record_digest(chunks).collect()}
    assert len(got) == len(rows)
    keeper = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 1000:
            keeper[h] = max(keeper.get(h, 0), p)
    for p, _, h in rows:
        raw = (h or "").encode()
        first = keeper.get(h, p)
        assert (got[p].payload_bytes, got[p].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[p].record_type, got[p].refers_to) == (("response", None) if first == p else ("revisit", first))
    parts = sorted((r.chunk_no, bytes(r.data)) for r in chunks.where("page_id = 8").collect())
    assert len(parts) == 4 and max(len(d) for _, d in parts) <= warc.CHUNK_BYTES
    assert b"".join(d for _, d in parts) == rows[7][2].encode()
    assert got[8].n_chunks == 4
    empty = scratch.table(warc.write_archives(warc.plan_records(df.where("false")), f"{scratch.path}/none"), "none")
    assert warc.record_digest(warc.read_archives(empty)).count() == 0


def test_warc_repeated_and_null_ids(spark):
    """One record a row, whatever repeats; every large payload is stored once at least."""
    a, b, c = "a" * 1500, "b" * 1500, "c" * 1500
    rows = [(5, a), (5, b), (9, a), (10, b), (None, a), (None, c), (None, c), (7, "s"), (7, "s"), (11, None), (12, "z" * 999), (12, "z" * 999), (13, c[:1000]), (13, c[:1000])]
    df = spark.createDataFrame([(p, "u", h, "x", 3) for p, h in rows], "page_id long, url string, html string, digest string, keeper int").repartition(3)
    planned = [(str(r.page_id), r.html[:1], r.record_type, r.refers_to) for r in warc.plan_records(df).collect()]
    want = {("5", "a"): 9, ("5", "b"): 10, ("None", "a"): 9}
    assert len(planned) == len(rows) and all(r[3] == want.get(r[:2]) and (r[2] == "revisit") == (r[:2] in want) for r in planned)
    scratch = Scratch(spark, "test-warc")
    manifest = scratch.table(warc.write_archives(warc.plan_records(df), f"{scratch.path}/archives"), "manifest")
    got = warc.record_digest(warc.read_archives(manifest)).collect()
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    assert sorted((str(r.page_id), r.payload_digest) for r in got) == sorted((str(p), sha(h)) for p, h in rows)
    stored = {r.payload_digest for r in got if r.record_type == "response"}
    assert stored == {sha(h) for _, h in rows}


def test_warc_is_the_standard_format(tmp_path):
    sink = warc._Sink(store.open_output(f"file://{tmp_path}/x.warc.gz"), True)
    warc.write_record(sink, 5, "http://a", memoryview(b"hello"), "response", None)
    warc.write_record(sink, 6, "http://b", memoryview(b"hello"), "revisit", 5)
    sink.out.close()
    text = gzip.open(tmp_path / "x.warc.gz").read()
    assert text.count(b"WARC/1.1\r\n") == 2 and b"\r\n\r\nHTTP/1.1 200 OK" in text and text.endswith(b"\r\n\r\n\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(text[:-80].replace(b"hello", b"")), "cut"))


def test_media_round_trip(spark):
    texts = ["", None, "a", "é" * 96, "x" * 192, "x" * 193, "same", "same", "long " * 60000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "no id", 1)], "doc_id long, text string, media int").repartition(2)
    scratch = Scratch(spark, "test-media")
    manifest = scratch.table(media.write_archives(df, f"{scratch.path}/archives"), "manifest")
    images = media.read_archives(spark, manifest)
    rows = {r.doc_id: r for r in media.media_digest(images).collect()}
    assert len(rows) == len(texts) + 1 and rows[None].n_bytes == 5
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    same = [rows[6].asDict() | {"doc_id": 0}, rows[7].asDict() | {"doc_id": 0}]
    assert same[0] == same[1]
    stored = {r.key: bytes(r.media) for r in images.where("key = '3'").collect()}
    assert rows[3].media_sha256 == hashlib.sha256(stored["3"]).hexdigest() and rows[3].media_bytes == len(stored["3"])
    with zipfile.ZipFile(manifest.first().archive.removeprefix("file://")) as z:  # other tools read it too
        assert z.testzip() is None
    empty = scratch.table(media.write_archives(df.where("false"), f"{scratch.path}/none"), "none")
    assert media.read_archives(spark, empty).count() == 0
    again = spark.createDataFrame([(5, "one", b"k"), (5, "one", b"k"), (5, "two", b"k"), (None, "one", b"k")], "doc_id long, text string, key binary")
    kept = scratch.table(media.write_archives(again, f"{scratch.path}/more"), "again")
    found = media.media_digest(media.read_archives(spark, kept)).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in found) == [("5", 3)] * 3 + [("None", 3)] and len({r.media_sha256 for r in found}) == 2


def test_png_refuses_damage():
    image = media.to_png(media.pad(b"abc"))
    assert bytes(media.from_png(image).tobytes()) == b"abc".ljust(192)
    for bad in (image[:-1] + b"x", image[1:], image[:40] + b"\0" + image[41:]):
        with pytest.raises((ValueError, Exception)):
            media.from_png(bad)


def test_members_are_retried_from_their_offset(tmp_path, monkeypatch):
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    writer = media.ArchiveWriter(f"file://{tmp_path}/a.zip")
    bodies = [bytes([k]) * (50 + k) for k in range(5)]
    for k, b in enumerate(bodies):
        writer.add(f"{k}-0-{k}.png", b)
    size = writer.close()
    raw = (tmp_path / "a.zip").read_bytes()
    entries = list(media.directory(io.BytesIO(raw), size))
    opened = []

    class Flaky(io.BytesIO):
        def read(self, n=-1):
            if not opened or opened[-1] < 2:
                raise OSError("lost")
            return super().read(n)

    def again():
        opened.append(len(opened) + 1)
        return Flaky(raw)

    _, crc, length, offset = entries[3]
    body, _ = media.retried(again, Flaky(raw), crc, length, offset)
    assert body == bodies[3] and len(opened) == 2
    with pytest.raises(ValueError):
        media.retried(lambda: io.BytesIO(raw), io.BytesIO(raw), crc ^ 1, length, offset)
    ranges = media.MediaReader({"manifest": f"file://{tmp_path}/a.zip\t{size}", "range_bytes": "200"}).partitions()
    assert len(ranges) > 1 and np.sum([hi - lo for p in ranges for _, _, lo, hi in p.archives]) == size
