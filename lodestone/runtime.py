"""Session settings and the shared folder for intermediate tables.

Intermediate results that cut lineage are written as Parquet below the folder named by
``spark.checkpoint.dir``; that folder is visible to the driver and to every executor, so a lost
executor never takes a result with it.  Only where the setting is absent (tests, local runs) a
folder of the local machine is chosen.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "lodestone", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    cores = cores or os.cpu_count() or 4
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder shared by all machines, as a URI or path."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "lodestone-shared")
        os.makedirs(root, exist_ok=True)
        root = f"file://{root}"
    return root.rstrip("/")


#: Rows of an Arrow batch while intermediate tables are made: texts can be long, and each batch stands in the JVM and in Python.
BATCH_ROWS = 2000


_open: dict[str, Scratch] = {}


class Scratch:
    """A folder of its own below the shared root, for the tables of one query run.

    Results are lazy and read these tables, so the folder stays until it is dropped, or until :func:`sweep` or the
    end of the driver process drops all that are left.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/lodestone/{label}-{uuid.uuid4().hex[:12]}"
        _open[self.path] = self

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage ends here."""
        where = f"{self.path}/{name}"
        schema = df.schema
        key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", self.spark.conf
        before = conf.get(key)
        lower = not 0 < int(before) <= BATCH_ROWS
        if lower:
            conf.set(key, str(BATCH_ROWS))
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        finally:
            if lower:
                conf.set(key, before)
        return self.spark.read.schema(schema).parquet(where)

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        """Delete one table, or the whole folder."""
        jvm = SparkContext._jvm or self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        if not name:
            _open.pop(self.path, None)


#: Rows of a stored table up to which it is broadcast, and bytes of its files where rows are not counted.
FEW_ROWS, FEW_BYTES = 20_000, 256 << 10


def by_rows(df: DataFrame) -> DataFrame:
    """A stored table as one side of a join: broadcast if it has few rows, and otherwise not.

    Spark goes by the size of the files, and names in compressed files are a small part of what they are in memory.
    """
    return by_size(df, df.limit(FEW_ROWS + 1).count() <= FEW_ROWS)


def by_size(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df.hint("merge")


def sweep() -> int:
    """Drop the tables of all query runs of this process; none of their results can be read after it."""
    left = list(_open.values())
    for scratch in left:
        scratch.drop()
    return len(left)


@atexit.register
def _at_exit() -> None:
    try:
        sweep()
    except Exception:  # the JVM has ended before; an operator's clean-up of the shared folder is left to do
        _open.clear()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
