"""Registered queries and the tables they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.hashing import stable_hash
from sievework.operators.frame import gather

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows if there is any."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt out to all cores where the file has fewer pieces than there are
    cores. With more pieces than cores, as any large table has, nothing is moved."""
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() > cores else docs.repartition(cores, "doc_id")


def documents_with_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two targets, both missing for most of them."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


DOCUMENTS_WITH_TARGETS = "(select d.*, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id)"


def hash32(text: str, start: int = 1) -> str:
    """SQL twin of ``stable_hash``."""
    return f"(('0x' || substr(md5({text}), {start}, 8))::BIGINT)"


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scored rows (id, target, fold, y_true, score) with 256 score levels, so with ties.

    The score leans towards the label, as a model's would.
    """
    long = gather(table(spark, sf_dir, "labels"), "target", "y_true", ["quality", "toxic"])
    name = F.concat_ws("|", "target", F.col("doc_id").cast("string"))
    noise = F.pmod(stable_hash(name), F.lit(256)) / 256.0
    return long.filter(F.col("y_true").isNotNull()).select(
        F.col("doc_id").alias("id"),
        "target",
        (F.pmod(stable_hash(F.col("doc_id")), F.lit(3)) + 1).cast("int").alias("fold"),
        "y_true",
        (noise * 0.75 + F.col("y_true") * 0.25).alias("score"),
    )


SCORED = f"""(
  select doc_id as id, target, ({hash32('doc_id::varchar')} % 3 + 1)::INTEGER as fold, y_true,
    ({hash32("target || '|' || doc_id::varchar")} % 256) / 256.0::DOUBLE * 0.75 + y_true * 0.25::DOUBLE as score
  from (select doc_id, 'quality' as target, quality as y_true from labels
        union all select doc_id, 'toxic', toxic from labels) where y_true is not null)"""
