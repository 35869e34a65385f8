"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), with docs all that the stage before kept, and returns a table that
is written as Parquet and read again for the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, jaccard, lines, quality
from lodestone.runtime import Scratch, read_table


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of this input's documents."""
    model = quality.train(quality.labelled_sample(docs, read_table(spark, sf_dir, "labels")))
    out = _free(docs, "score")
    return quality.score(docs, model, out=out).where(F.col(out) >= 0.3).drop(out)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks that an earlier document has; those left empty by that go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`") for c in rest)).alias("row"))
    out = lines.dedup_lines(packed, Scratch(spark, "stage-lines"), every_holder=True).where("n_removed = 0 or text <> ''")
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return out.select(*(made[c] if c in made else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates; documents without an id stay.  Rows that repeat an
    id are one document, which goes if any of its texts has an earlier near duplicate."""
    found = jaccard.near_duplicates(docs, Scratch(spark, "stage-jaccard"))
    later = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    out = _free(docs, "items")
    return decontaminate.find_items(docs, read_table(spark, sf_dir, "benchmark"), out=out).where(F.size(out) == 0).drop(out)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.round_trip_digest(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe_tokens", bpe_tokens),
]

#: The classifier and the alignment are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
