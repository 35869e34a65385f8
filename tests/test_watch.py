"""A tree's changes as a stream, bursts by timers, and an index that follows its tree."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lodestone.plans.engine import Engine
from lodestone.schemas import FS_EVENTS
from lodestone.sources import tree_events
from lodestone.sources.tree_events import EventLog, compare, walk
from lodestone.streaming import watch


def put(root, path, text):
    path = root / path
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def wait_for(condition, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if condition():
            return True
        time.sleep(0.2)
    return False


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "tree"
    for path in ("a/x.py", "a.py", "a/b/y.py", "node_modules/n.js", "z.md"):
        put(root, path, "one")
    return root


def test_log_tells_every_change_once(root, tmp_path):
    log = EventLog(str(root), str(tmp_path / "log"))
    assert log.number() is None and log.poll(silent=True) == 0 and log.poll() == 0
    put(root, "a/x.py", "other")
    put(root, "b/new.py", "two")
    put(root, "node_modules/more.js", "skipped")
    os.remove(root / "z.md")
    assert log.poll() == 1 and log.poll() == 1
    assert {(p, k) for _, p, k in log.read(1)} == {("a/x.py", "modify"), ("b/new.py", "create"), ("z.md", "remove")}
    os.rename(root / "a", root / "c")
    assert EventLog(str(root), f"file://{tmp_path}/log").poll() == 2
    assert {(p, k) for _, p, k in log.read(2)} == {("a/x.py", "remove"), ("a/b/y.py", "remove"), ("c/x.py", "create"), ("c/b/y.py", "create")}
    log.forget(1)
    assert not os.path.exists(log.file(1)) and os.path.exists(log.file(2))


def test_snapshot_cut_off_before_it_was_taken(root, tmp_path, monkeypatch):
    """A crash between the changes and their snapshot: the same changes are found again, none is lost."""
    log = EventLog(str(root), str(tmp_path / "log"))
    log.poll(silent=True)
    put(root, "new.py", "1")
    real = os.replace

    def crash(a, b):
        if b.endswith("snapshot.jsonl"):
            raise KeyboardInterrupt
        real(a, b)

    monkeypatch.setattr(os, "replace", crash)
    with pytest.raises(KeyboardInterrupt):
        log.poll()
    monkeypatch.setattr(os, "replace", real)
    put(root, "newer.py", "2")
    assert log.number() == 0 and log.poll() == 1
    assert {(p, k) for _, p, k in log.read(1)} == {("new.py", "create"), ("newer.py", "create")}


def test_walk_is_in_the_order_of_compare(root):
    found = [p for p, _ in walk(str(root))]
    assert found == sorted(found) == [("a", "b", "y.py"), ("a", "x.py"), ("a.py",), ("z.md",)]
    assert list(compare(iter([]), iter([]))) == []


def test_source_goes_on_from_its_offset(spark, root, tmp_path):
    """Rows come once each over two runs of a query; what changed between them is told."""
    def run():
        stream = tree_events.changes(spark, str(root), str(tmp_path / "log"))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
        return query

    def seen():
        return sorted((r.path, r.kind) for r in spark.read.schema(FS_EVENTS).parquet(str(tmp_path / "out")).collect()) if os.path.exists(tmp_path / "out/_spark_metadata") else []

    query = run()
    assert wait_for(lambda: (tmp_path / "log/snapshot.jsonl").exists())
    put(root, "n1.py", "1")
    assert wait_for(lambda: seen() == [("n1.py", "create")])
    query.stop()
    put(root, "n2.py", "2")
    os.remove(root / "n1.py")
    query = run()
    want = [("n1.py", "create"), ("n1.py", "remove"), ("n2.py", "create")]
    assert wait_for(lambda: seen() == want)
    time.sleep(1)
    query.stop()
    assert seen() == want


def test_live_bursts_equal_those_of_the_batch(spark, tmp_path):
    """Events that come in bursts give the same bursts as the recorded table does; the last needs no later event."""
    folder, gap = tmp_path / "events", "2 seconds"
    folder.mkdir()
    keys = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in keys}
    events = watch.read_events(spark, str(folder), FS_EVENTS)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", watch.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = watch.live_batches(events, gap).writeStream.format("memory").queryName("live").outputMode("append").trigger(processingTime="200 milliseconds").start()
    for k in keys:
        spark.conf.set(k, before[k])
    bursts = [[("r", "a.py"), ("r", "b.py"), ("r", "a.py"), ("s", "q.py"), ("r", "target/skip.py")], [("r", "c.py")]]
    try:
        for n, burst in enumerate(bursts):
            now = spark.sql("select date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSXXX\")").first()[0]
            part = tmp_path / "part"
            part.write_text("\n".join(json.dumps({"ts": now, "root": r, "path": p, "kind": "modify"}) for r, p in burst))
            os.replace(part, folder / f"{n}.json")
            done = {(r, p) for b in bursts[: n + 1] for r, p in b if "target" not in p}
            assert wait_for(lambda done=done: {(r.root, r.path) for r in spark.sql("select root, path from live where kind = 'path'").collect()} == done)
    finally:
        query.stop()
    paths = spark.table("live").where("kind = 'path'").groupBy("root", "begin", "end").agg(F.sort_array(F.collect_set("path")).alias("paths"), F.sum("n_events").alias("n_events"))
    batch = watch.quiet_batches(spark.read.schema(FS_EVENTS).json(str(folder)), gap)
    rows = lambda df: sorted(map(repr, df.select("root", "begin", "end", "paths", "n_events").collect()))
    assert rows(paths) == rows(batch) and paths.count() == 3
    counts = [r.pending for r in spark.table("live").where("kind = 'pending' and root = 'r'").collect()]
    assert max(counts) == 2 and counts.count(0) == 2


def test_index_follows_its_tree(spark, root, tmp_path):
    """The first edit is applied after the gap though nothing follows it; status tells what waits; a new run goes on."""
    engine = Engine(spark, str(tmp_path / "wh"), str(root))
    engine.ensure()
    files = lambda: {r.relative_path: r.content for r in engine.warehouse.read("files").select("relative_path", "content").collect()}
    query = watch.follow(engine, str(tmp_path / "cp"), gap="3 seconds", processingTime="300 milliseconds")
    try:
        assert wait_for(lambda: (tmp_path / "cp/tree-log/snapshot.jsonl").exists())
        put(root, "a/x.py", "import z")
        put(root, "new.py", "import a")
        assert wait_for(lambda: engine.status().first().pending == 2)
        assert wait_for(lambda: files().get("new.py") == "import a") and files()["a/x.py"] == "import z"
        assert wait_for(lambda: engine.status().first().pending == 0)
        status = engine.status().first()
        assert status.watcher == "running" and status.last_update is not None and status.update_seconds > 0
    finally:
        query.stop()
    os.remove(root / "z.md")
    query = watch.follow(engine, str(tmp_path / "cp"), gap="1 seconds", processingTime="300 milliseconds")
    try:
        assert wait_for(lambda: "z.md" not in files())
    finally:
        query.stop()
    assert engine.status().first().watcher == "stopped"
