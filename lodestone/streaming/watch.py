"""Maintenance from a stream of file events (ts, root, path, kind).

Events of one root are gathered until it has been quiet for the gap, and then applied together.  Nothing is
dropped when events come fast.

:func:`quiet_batches` finds bursts by the events' own times, on a table or on a stream with a watermark.
:func:`live_batches` is for a running index: it keeps the pending paths of a root as state, with a timer that every
event sets anew, so the last burst is told once the gap has passed and needs no later event.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.plans.engine import Engine
from lodestone.runtime import Scratch
from lodestone.sources import tree_events
from lodestone.sources.files import read_file, should_skip
from lodestone.schemas import FILES, LIVE

#: Fixed value: quiet time before a batch is applied.
GAP = "150 milliseconds"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LIVE_ROW = Row(*LIVE.fieldNames())
_UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000}


def read_events(spark, folder: str, schema) -> DataFrame:
    """A stream of event files."""
    return spark.readStream.schema(schema).json(folder)


def milliseconds(gap: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*(millisecond|second|minute)s?\s*", gap)
    if not m:
        raise ValueError(f"no gap: {gap!r}")
    return int(m[1]) * _UNITS[m[2]]


def quiet_batches(events: DataFrame, gap: str = GAP, delay: str | None = None, key: str = "root", path: str = "path", ts: str = "ts") -> DataFrame:
    """key, begin, end, paths (distinct, sorted): a row for each burst.  On a stream, ``delay`` is how late
    events may come; a burst is emitted once the watermark has passed its end."""
    if events.isStreaming or delay:
        events = events.withWatermark(ts, delay or "0 seconds")
    kept = events.where(~should_skip(F.col(path)))
    bursts = kept.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.sort_array(F.collect_set(path)).alias("paths"), F.count(F.lit(1)).alias("n_events"))
    return bursts.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "paths", "n_events")


class Debounce(StatefulProcessor):
    """Pending paths of a root, told when the gap has passed since the root's last event was processed."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "n_events long")
        self.burst = handle.getValueState("burst", "begin timestamp, last timestamp, pending long, timer long")

    def _pending(self, key: tuple, n: int) -> Row:
        return _LIVE_ROW(key[0], "pending", None, None, None, None, n)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        begin = last = None
        pending, timer = 0, None
        if self.burst.exists():
            begin, last, pending, timer = self.burst.get()
        while True:
            came: Counter[str] = Counter()
            for row in rows:
                came[row.path] += 1
                begin, last = min(begin or row.ts, row.ts), max(last or row.ts, row.ts)
                if len(came) == 10_000:
                    break
            if not came:
                break
            for path, n in came.items():
                before = self.paths.getValue((path,))[0] if self.paths.containsKey((path,)) else None
                self.paths.updateValue((path,), ((before or 0) + n,))
                pending += before is None
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.gap_ms
        self.handle.registerTimer(timer)
        self.burst.update((begin, last, pending, timer))
        yield self._pending(key, pending)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        begin, last, _, _ = self.burst.get()
        for (path,), (n,) in self.paths.iterator():
            yield _LIVE_ROW(key[0], "path", begin, last + timedelta(milliseconds=self.gap_ms), path, n, None)
        self.paths.clear()
        self.burst.clear()
        yield self._pending(key, 0)

    def close(self) -> None:
        pass


def live_batches(events: DataFrame, gap: str = GAP) -> DataFrame:
    """LIVE rows of a stream of events: a row for each path of a burst that ended, and the pending paths of roots
    whenever they change.  Needs RocksDB as the provider of state, which :func:`start` sets."""
    kept = events.where(~should_skip(F.col("path"))).select("root", "path", F.coalesce("ts", F.current_timestamp()).alias("ts"))
    return kept.groupBy("root").transformWithState(Debounce(milliseconds(gap)), LIVE, outputMode="Append", timeMode="ProcessingTime")


def apply_batch(engine: Engine, root: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: paths that exist are read again, others are deleted; index and graph follow.

    A batch has ``paths`` (of :func:`quiet_batches`) or the rows of :func:`live_batches`.
    """

    def read(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]
        for b in batches:
            found_now = [(p, read_file(root, p)) for p in b.column(0).to_pylist()]
            rows = [(*row, True) if row else (p, None, None, None, None, False) for p, row in found_now]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*FILES.fieldNames(), "there"])

    def apply(batch: DataFrame, _: int) -> None:
        live = "pending" in batch.columns
        if not live:
            run(batch.select(F.explode("paths").alias("relative_path")))
            return
        mine = batch.where(F.col("root") == root).persist()  # state must not be stepped again for the second look
        try:
            row = mine.where("kind = 'pending'").select("pending").first()  # one a root at most
            if row is not None and row.pending:
                engine.pending["paths"] = row.pending
            elif row is not None:
                run(mine.where("kind = 'path'").select(F.col("path").alias("relative_path")))
                engine.pending["paths"] = 0
        finally:
            mine.unpersist()

    def run(paths: DataFrame) -> None:
        schema = T.StructType([*FILES.fields, T.StructField("there", T.BooleanType())])
        # a table of its own: files change, and must not be read again where an executor is lost
        scratch, began = Scratch(engine.spark, "events"), time.time()
        try:
            found = scratch.table(paths.distinct().mapInArrow(read, schema), "found")
            if not found.isEmpty():
                engine.apply(found.where("there").drop("there"), found.where("not there").select("relative_path"))
                engine.pending |= {"last_update": datetime.now(), "seconds": time.time() - began}
        finally:
            scratch.drop()

    return apply


def start(events: DataFrame, engine: Engine, root: str, checkpoint: str, gap: str = GAP, partitions: int = 1, **trigger):
    """Run maintenance: a burst is applied when its root has been quiet for the gap, with or without later events.

    ``partitions`` is how many tasks share the state of roots; :meth:`Engine.status` tells the pending paths.
    """
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": str(partitions)}
    conf = engine.spark.conf
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:  # a query keeps the settings it was started under
        writer = live_batches(events, gap).writeStream.outputMode("append").foreachBatch(apply_batch(engine, root)).option("checkpointLocation", checkpoint)
        engine.watcher = writer.trigger(**(trigger or {"processingTime": f"{milliseconds(gap)} milliseconds"})).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return engine.watcher


def follow(engine: Engine, checkpoint: str, gap: str = GAP, **trigger):
    """Keep the index of the engine's root up to date with its tree; goes on where an earlier run ended."""
    events = tree_events.changes(engine.spark, engine.root, f"{checkpoint.rstrip('/')}/tree-log")
    return start(events, engine, engine.root, checkpoint, gap, **trigger)
