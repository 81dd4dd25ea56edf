"""The corpus pipeline: quality, line dedup, near-dedup, decontamination and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import catalog, decontaminate, line_dedup, packing, setsketch, site_quality
from sievework.llm.stored import all_columns, materialize
from sievework.plans.registry import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality posterior is at least a half."""
    return site_quality.keep_good(docs, catalog.labels_of(spark, sf_dir, "quality"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; what is copied entirely goes."""
    return line_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies on five-word shingles at 0.8."""
    gone = setsketch.near_duplicates(docs, size=5, percent=80).filter(~F.col("kept")).select("doc_id")
    return docs.join(materialize(gone, "copies").hint("merge"), "doc_id", "left_anti").select(*all_columns(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*all_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens."""
    return packing.pack(docs, *catalog.token_files())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-dedup", near_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Classifier, near-dedup and packing have no SQL; run() is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
