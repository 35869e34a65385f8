"""Source files of a directory tree as a Spark data source.

``spark.read.format("source_tree").option("root", folder).load()`` walks a tree that driver and executors
share.  Skipped: hidden entries, folders that hold builds or dependencies, what ignore files name,
files over 1 MiB, unknown extensions, and contents that are no UTF-8.  Spark's own file index is not used,
as it silently drops names that begin with an underscore.

The data source lists the tree's names on the driver, one folder at a time; each task reads the files of some
folders.  :func:`scan_in_rounds` gives the same rows and lists in tasks too: each lists some folders with the ignore
rules that hold there, descends while it has found few names, and hands on the folders that are left, with their
rules, as rows of a table that the next round starts from.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions.analyze import DOC_EXTENSIONS
from lodestone.runtime import Scratch
from lodestone.schemas import FILES

#: What is indexed and what is skipped.
CODE_EXTENSIONS = (
    "rs", "ts", "tsx", "js", "jsx", "mjs", "py", "go", "java", "c", "cpp", "h", "hpp",
    "rb", "php", "swift", "kt", "scala", "zig", "lua", "sh", "bash", "zsh",
    "css", "scss", "html", "vue", "svelte", "sql", "proto", "toml", "yaml", "yml",
    "json", "xml", "md", "txt", "rst", "org",
)
MAX_FILE_BYTES = 1_048_576
SKIP_DIRS = ("node_modules", "target", ".git", ".archive", "__pycache__", ".venv", "vendor", "dist", "build", ".next", ".lodestone")

FOLDERS_PER_TASK = 64
#: Names that a listing task finds before it hands on the folders that are left.
NAMES_PER_TASK = 5000


def should_skip(path: Column) -> Column:
    """Whether any part of a path is a skipped folder."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(d) for d in SKIP_DIRS)))


def extension_of(path: Column) -> Column:
    """In lower case, '' without one; a name's leading dot begins none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.].*\.([^.]*)$|^[^.]\.([^.]*)$", 1))


def indexable(files: DataFrame, size: str = "n_bytes") -> DataFrame:
    """The scan's filters for rows with relative_path, a size (null passes) and content."""
    ext = extension_of(F.col("relative_path"))
    return files.where(~should_skip(F.col("relative_path")) & ext.isin(*CODE_EXTENSIONS) & (F.col(size).isNull() | (F.col(size) <= MAX_FILE_BYTES)))


def derive(files: DataFrame) -> DataFrame:
    """extension, is_code and content_hash for rows of relative_path and content."""
    ext = extension_of(F.col("relative_path"))
    return files.select("relative_path", "content", ext.alias("extension"), (~ext.isin(*DOC_EXTENSIONS)).alias("is_code"), F.sha2(F.encode("content", "UTF-8"), 256).alias("content_hash"))


class IgnoreRules:
    """The rules of ignore files: the last rule that matches decides; ``!`` takes back."""

    def __init__(self, rules: list[tuple[str, str, bool, bool]] | None = None):
        self.rules = rules or []

    def extended(self, base: str, text: str) -> IgnoreRules:
        added = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dir = line.endswith("/")
            line = line.rstrip("/")
            if not line:
                continue
            pattern = line.lstrip("/") if "/" in line else f"**/{line}"
            added.append((base, _glob(pattern), only_dir, keep))
        return IgnoreRules(self.rules + added)

    def ignored(self, path: str, is_dir: bool) -> bool:
        out = False
        for base, pattern, only_dir, keep in self.rules:
            if only_dir and not is_dir or base and not path.startswith(base + "/"):
                continue
            if re.fullmatch(pattern, path[len(base) + 1 :] if base else path):
                out = not keep
        return out


def _glob(pattern: str) -> str:
    parts = re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]*\])", pattern)
    special = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(special.get(p) or (fnmatch.translate(p)[4:-3] if p.startswith("[") else re.escape(p)) for p in parts)


def _rules_of(folder: str, base: str, rules: IgnoreRules) -> IgnoreRules:
    for name in (".gitignore", ".ignore"):
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                rules = rules.extended(base, f.read())
        except OSError:
            pass
    return rules


def _global_rules() -> IgnoreRules:
    """Rules of the user's global ignore file: the one git's configuration names, or the default one."""
    home = os.path.expanduser("~")
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    where = os.path.join(base, "git", "ignore")
    for config in (os.path.join(base, "git", "config"), os.path.join(home, ".gitconfig")):
        try:
            with open(config, encoding="utf-8", errors="replace") as f:
                found = re.findall(r"(?im)^\s*excludesfile\s*=\s*\"?([^\"\n]+?)\"?\s*$", f.read())
        except OSError:
            continue
        if found:
            where = os.path.expanduser(found[-1])
    try:
        with open(where, encoding="utf-8", errors="replace") as f:
            return IgnoreRules().extended("", f.read())
    except OSError:
        return IgnoreRules()


def _rules_above(root: str, rules: IgnoreRules) -> tuple[str, IgnoreRules]:
    """The repository that a root lies in (or the root), with the rules of all folders above the root."""
    top = here = os.path.abspath(root)
    while not os.path.exists(os.path.join(here, ".git")):
        above = os.path.dirname(here)
        if above == here:
            return top, rules
        here = above
    top, at = here, here
    try:
        with open(os.path.join(top, ".git", "info", "exclude"), encoding="utf-8", errors="replace") as f:
            rules = rules.extended("", f.read())
    except OSError:
        pass
    for part in [x for x in os.path.relpath(os.path.abspath(root), top).split(os.sep) if x != "."]:
        rules = _rules_of(at, os.path.relpath(at, top).replace(os.sep, "/").removeprefix("."), rules)
        at = os.path.join(at, part)
    return top, rules


def _start(root: str) -> tuple[str, IgnoreRules]:
    """What comes before a path when rules look at it, and the rules that hold at the root."""
    top, start = _rules_above(root, _global_rules())
    lead = os.path.relpath(os.path.abspath(root), top).replace(os.sep, "/")
    return "" if lead == "." else f"{lead}/", start  # rules name paths from the top of the repository


def folders(root: str) -> Iterator[tuple[str, list[str]]]:
    """Each folder below a root with its indexable file names; what cannot be listed is skipped.

    Ignored is what the user's global ignore file, the repository's exclude file, and the ignore files of the
    folders from the repository's top down say; the deepest rule that matches decides.
    """
    lead, start = _start(root)
    work = [("", start)]
    while work:
        base, rules = work.pop()
        names, below, rules = list_folder(root, lead, base, rules)
        work += [(path, rules) for path in below]
        if names:
            yield base, names


def list_folder(root: str, lead: str, base: str, rules: IgnoreRules) -> tuple[list[str], list[str], IgnoreRules]:
    """Indexable names in a folder, paths of the folders below it, and the rules that hold there."""
    here = os.path.join(root, base) if base else root
    rules = _rules_of(here, f"{lead}{base}".rstrip("/"), rules)
    names: list[str] = []
    below: list[str] = []
    try:
        entries = sorted(os.scandir(here), key=lambda e: e.name)
    except OSError:
        return names, below, rules
    for e in entries:
        if e.name.startswith(".") or e.name in SKIP_DIRS:
            continue
        path = f"{base}/{e.name}" if base else e.name
        try:
            if e.is_dir(follow_symlinks=False):
                if not rules.ignored(lead + path, True):
                    below.append(path)
            elif e.is_file(follow_symlinks=False) and _extension(e.name) in CODE_EXTENSIONS and not rules.ignored(lead + path, False):
                names.append(e.name)
        except OSError:
            continue
    return names, below, rules


def _extension(name: str) -> str:
    return os.path.splitext(name)[1][1:].lower()


def read_file(root: str, relative_path: str) -> tuple | None:
    """One file as a row of FILES, or None where size, extension or encoding exclude it; ignore rules do not apply."""
    ext = _extension(relative_path)
    path = os.path.join(root, relative_path)
    try:
        if ext not in CODE_EXTENSIONS or not os.path.isfile(path) or os.path.getsize(path) > MAX_FILE_BYTES:
            return None
        with open(path, "rb") as f:
            raw = f.read()
        content = raw.decode("utf-8")
    except (OSError, UnicodeDecodeError):
        return None
    return relative_path, content, ext, ext not in DOC_EXTENSIONS, hashlib.sha256(raw).hexdigest()


class FolderPartition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self):
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return SourceTreeReader(self.options["root"])


class SourceTreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        out, part, n = [], [], 0
        for base, names in folders(self.root):
            part += [f"{base}/{x}" if base else x for x in names]
            n += 1
            if n == FOLDERS_PER_TASK or len(part) >= 2000:
                out.append(FolderPartition(part))
                part, n = [], 0
        return out + [FolderPartition(part)]

    def read(self, partition: FolderPartition) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.paths:
            row = read_file(self.root, path)
            if row is not None:
                rows.append(row)
                size += len(row[1])
            if size > 16 << 20:
                yield self._batch(rows)
                rows, size = [], 0
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return _file_rows(rows)


def _file_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=FILES.fieldNames())


def scan(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("root", root).load()


def _list_rows(batches: Iterator[pa.RecordBatch], root: str, lead: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (folder, rules) to rows of files (rules null) and of folders that are left to list."""
    found: list[tuple[str, str | None]] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([r for _, r in found], pa.string())], names=["path", "rules"])
        found.clear()
        return out

    for batch in batches:
        for folder, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            work, n = deque([(folder, IgnoreRules([tuple(r) for r in json.loads(told)]))]), 0
            while work and (n < limit or work[0][0] == folder):  # breadth first, so that many small subtrees are handed on
                base, rules = work.popleft()
                names, below, rules = list_folder(root, lead, base, rules)
                n += len(names) + len(below)
                found += [(f"{base}/{x}" if base else x, None) for x in names]
                work.extend((path, rules) for path in below)
            told_on = {id(rules): json.dumps(rules.rules) for _, rules in work}
            found += [(base, told_on[id(rules)]) for base, rules in work]
            if len(found) > 10_000:
                yield flush()
    yield flush()


def list_in_rounds(spark: SparkSession, root: str, scratch: Scratch, limit: int = NAMES_PER_TASK) -> DataFrame:
    """relative_path of every indexable file.  The driver holds neither names nor folders, only how many rounds there were."""
    lead, start = _start(root)
    parts = spark.sparkContext.defaultParallelism
    todo = spark.createDataFrame([("", json.dumps(start.rules))], "path string, rules string")
    rounds = []
    while True:
        found = scratch.table(todo.mapInArrow(lambda it: _list_rows(it, root, lead, limit), "path string, rules string"), f"names-{len(rounds)}")
        rounds.append(found.where("rules is null").select(F.col("path").alias("relative_path")))
        left = found.where("rules is not null")
        if left.isEmpty():
            return reduce(DataFrame.union, rounds)
        todo = left.repartition(parts)


def scan_in_rounds(spark: SparkSession, root: str, scratch: Scratch, limit: int = NAMES_PER_TASK) -> DataFrame:
    """The rows of :func:`scan`, listed and read by tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path in batch.column(0).to_pylist():
                row = read_file(root, path)
                if row is not None:
                    rows.append(row)
                    size += len(row[1])
                if size > 16 << 20:
                    yield _file_rows(rows)
                    rows, size = [], 0
            yield _file_rows(rows)

    names = list_in_rounds(spark, root, scratch, limit)
    return names.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(read, FILES)
