"""Changes of a directory tree as a streaming data source.

``spark.readStream.format("tree_events").option("root", folder).option("log", folder).load()`` gives a row
(ts, root, path, kind) for each file below the root that is created, modified or removed.  Whenever Spark asks for
the latest offset, the tree is compared with the snapshot that was taken before.  Both are walked in one order, so
the comparison holds two entries at a time, however many files there are.  What differs is written to a numbered
file of the log, then the new snapshot takes the old one's place; an offset is the number of a log file.

So rows of an offset are the same whenever they are read, and a query that starts again goes on from its last
offset; what changed while none ran is found by its first comparison.  The log lies in a folder that driver and
executors share.  Files of the log go when Spark has committed their offset.

A first start begins with the tree as it is (``from`` = ``now``) or tells all its files as created (``from`` =
``start``).  Names of skipped folders are left out; ignore files do not apply to events.  A change is told by size,
time of modification, or file number.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodestone.schemas import FS_EVENTS
from lodestone.sources.files import SKIP_DIRS

Entry = tuple[tuple[str, ...], list[int]]


def walk(root: str, at: tuple[str, ...] = ()) -> Iterator[Entry]:
    """(parts of the path, [size, time, number]) of each file, in the order of the parts; what cannot be read is skipped."""
    try:
        entries = sorted(os.scandir(os.path.join(root, *at)), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        if e.name in SKIP_DIRS:
            continue
        try:
            if e.is_dir(follow_symlinks=False):
                yield from walk(root, (*at, e.name))
            elif e.is_file(follow_symlinks=False):
                s = e.stat(follow_symlinks=False)
                yield (*at, e.name), [s.st_size, s.st_mtime_ns, s.st_ino]
        except OSError:
            continue


def compare(old: Iterator[Entry], new: Iterator[Entry]) -> Iterator[tuple[str | None, tuple[str, ...], list[int] | None]]:
    """(kind or None, path, state now or None) of each entry of either side; both are in order."""
    a, b = next(old, None), next(new, None)
    while a or b:
        if b is None or a is not None and a[0] < b[0]:
            yield "remove", a[0], None
            a = next(old, None)
        elif a is None or b[0] < a[0]:
            yield "create", b[0], b[1]
            b = next(new, None)
        else:
            yield ("modify" if a[1] != b[1] else None), b[0], b[1]
            a, b = next(old, None), next(new, None)


class EventLog:
    """The snapshot and the numbered files of changes below one folder."""

    def __init__(self, root: str, folder: str):
        self.root = root
        self.folder = folder.removeprefix("file://").replace("file:/", "/", 1)
        os.makedirs(self.folder, exist_ok=True)
        self._snapshot = os.path.join(self.folder, "snapshot.jsonl")

    def file(self, number: int) -> str:
        return os.path.join(self.folder, f"{number}.jsonl")

    def number(self) -> int | None:
        """The number of the last changes that the snapshot has; None before the first."""
        try:
            with open(self._snapshot, encoding="utf-8") as f:
                return json.loads(f.readline())
        except FileNotFoundError:
            return None

    def _entries(self) -> Iterator[Entry]:
        try:
            with open(self._snapshot, encoding="utf-8") as f:
                next(f)
                for line in f:
                    parts, state = json.loads(line)
                    yield tuple(parts), state
        except FileNotFoundError:
            return

    def poll(self, silent: bool = False) -> int:
        """Compare the tree with the snapshot; the number of the last changes.  ``silent`` takes a snapshot only."""
        last = self.number()
        number = (last or 0) + (not silent)
        now = datetime.now(timezone.utc).isoformat()
        found = 0
        new, changes = f"{self._snapshot}.new", f"{self.file(number)}.new"
        with open(new, "w", encoding="utf-8") as snapshot, open(changes, "w", encoding="utf-8") as log:
            snapshot.write(f"{number}\n")
            for kind, parts, state in compare(self._entries(), walk(self.root)):
                if state is not None:
                    snapshot.write(json.dumps([parts, state]) + "\n")
                if kind and not silent:
                    found += 1
                    log.write(json.dumps([now, "/".join(parts), kind]) + "\n")
        if found or last is None:
            # changes first: without its snapshot a file of changes is written anew by the next comparison
            os.replace(changes, self.file(number))
            os.replace(new, self._snapshot)
            return number
        os.remove(changes)
        os.remove(new)
        return last

    def read(self, number: int) -> Iterator[tuple[datetime, str, str]]:
        with open(self.file(number), encoding="utf-8") as f:
            for line in f:
                ts, path, kind = json.loads(line)
                yield datetime.fromisoformat(ts), path, kind

    def forget(self, number: int) -> None:
        """Drop the files up to a number."""
        for name in os.listdir(self.folder):
            stem = name.removesuffix(".jsonl")
            if stem.isdigit() and int(stem) <= number:
                os.remove(os.path.join(self.folder, name))


class ChangesPartition(InputPartition):
    def __init__(self, number: int):
        self.number = number


class TreeEventReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.folder, self.begin = options["root"], options["log"], options.get("from", "now")
        if self.begin not in ("now", "start"):
            raise ValueError("from is now or start")

    def _log(self) -> EventLog:
        return EventLog(self.root, self.folder)

    def initialOffset(self) -> dict:
        log = self._log()
        last = log.number()
        if last is None:
            last = log.poll(silent=True) if self.begin == "now" else 0
        return {"number": last}

    def latestOffset(self) -> dict:
        return {"number": self._log().poll()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [ChangesPartition(k) for k in range(start["number"] + 1, end["number"] + 1)]

    def read(self, partition: ChangesPartition) -> Iterator[tuple]:
        for ts, path, kind in self._log().read(partition.number):
            yield ts, self.root, path, kind

    def commit(self, end: dict) -> None:
        self._log().forget(end["number"])


class TreeEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_events"

    def schema(self):
        return FS_EVENTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeEventReader(dict(self.options))


def changes(spark: SparkSession, root: str, log: str, begin: str = "now") -> DataFrame:
    """A stream of the changes below ``root``."""
    spark.dataSource.register(TreeEvents)
    return spark.readStream.format("tree_events").option("root", root).option("log", log).option("from", begin).load()
