"""Tables and models whose versions become visible at once, and features that are kept.

A version is a folder ``version-<number>`` below a root. It is written under another name and
renamed when it is whole, so a reader sees a version entirely or not at all; a write that dies
leaves the last one as it was. Readers take the highest number.

A feature table's version holds the features of new and changed rows only, and a manifest: for
every key a digest of the row and the version that has its features.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.dedup import JSON
from sievework.session import materialize

PREFIX = "version-"


def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that are whole, rising."""
    _, path, fs = _files(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[len(PREFIX) :]) for n in names if n.startswith(PREFIX))


def version_path(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/{PREFIX}{number:08d}"


def publish(spark: SparkSession, root: str, write: Callable[[str, int], None]) -> int:
    """Write a version with ``write(path, number)`` and make it visible by one rename.

    Two writers get one number each or one of them an error: a version is never replaced.
    """
    number = max(versions(spark, root), default=0) + 1
    work = f"{root.rstrip('/')}/_work-{uuid.uuid4().hex}"
    write(work, number)
    jvm, path, _ = _files(spark, root)
    at = lambda text: jvm.org.apache.hadoop.fs.Path(text)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(at(work), at(version_path(root, number)), options)
    return number


def latest(spark: SparkSession, root: str) -> str:
    """Path of the newest version."""
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"no version below {root}")
    return version_path(root, found[-1])


@dataclass(frozen=True)
class Refresh:
    """A new version, and how many rows' features were computed, kept and dropped for it."""

    version: int
    computed: int
    kept: int
    dropped: int


def _digests(df: DataFrame, key: str) -> DataFrame:
    named = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sorted(df.columns))])
    return df.select(F.col(f"`{key}`").alias("key"), F.unhex(F.md5(F.to_json(named, JSON))).alias("digest"))


def refresh(df: DataFrame, key: str, root: str, features: Callable[[DataFrame], DataFrame]) -> Refresh:
    """Publish a version of ``features(df)`` that computes features of new and changed rows only.

    ``key`` is unique and not null, else a ValueError is raised and nothing published. ``features``
    adds columns to rows and looks at nothing but the row. Rows are compared by a digest of all
    columns, which are known by name; a changed definition of ``features`` needs a new root.
    """
    spark = df.sparkSession
    now = materialize(_digests(df, key), "digests")
    count = now.agg(F.count(F.lit(1)).alias("n"), F.count("key").alias("keys"), F.count_distinct("key").alias("distinct")).first()
    if count.n != count["distinct"]:
        raise ValueError(f"{key} is not a unique key: {count.n} rows, {count['keys']} with a key, {count['distinct']} keys")
    known = versions(spark, root)
    before = spark.read.parquet(f"{version_path(root, known[-1])}/manifest") if known else None
    kept = now.join(before, ["key", "digest"]) if before is not None else now.withColumn("at", F.lit(0).cast("bigint")).limit(0)
    kept = materialize(kept, "kept")
    fresh = now.join(kept.select("key"), "key", "left_anti")
    result: list[Refresh] = []

    def write(path: str, number: int) -> None:
        rows = df.join(fresh.select(F.col("key").alias(key)), key, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
        features(rows).write.parquet(f"{path}/data")
        manifest = kept.unionByName(fresh.withColumn("at", F.lit(number).cast("bigint")))
        manifest.write.parquet(f"{path}/manifest")
        live = spark.read.parquet(f"{path}/manifest").groupBy("at").agg(F.count(F.lit(1)).alias("live"))
        # One row per version that still has rows.
        spread = {r["at"]: r["live"] for r in live.collect()}
        written = {number: spark.read.parquet(f"{path}/data").count()}
        if before is not None:
            written |= {r["at"]: r["written"] for r in spark.read.parquet(f"{version_path(root, known[-1])}/parts").collect()}
        rows = [(at, n, written[at]) for at, n in spread.items()]
        spark.createDataFrame(rows, "at bigint, live bigint, written bigint").coalesce(1).write.parquet(f"{path}/parts")
        computed = spread.get(number, 0)
        if written[number] != computed:
            raise ValueError("features keep every row once")
        result.append(Refresh(number, computed, count.n - computed, (before.count() if before is not None else 0) - (count.n - computed)))

    publish(spark, root, write)
    return result[0]


def read_features(spark: SparkSession, root: str, key: str, version: int | None = None) -> DataFrame:
    """The rows of a version with their features and ``_version``, the one that computed them.

    Versions all of whose rows still hold are read as they are; of others the rows in use are
    picked by the manifest.
    """
    path = latest(spark, root) if version is None else version_path(root, version)
    manifest, parts = spark.read.parquet(f"{path}/manifest"), []
    newest = spark.read.parquet(f"{path}/data").withColumn("_version", F.lit(None).cast("bigint")).limit(0)
    for r in spark.read.parquet(f"{path}/parts").orderBy("at").collect():
        data = spark.read.parquet(f"{version_path(root, r['at'])}/data").withColumn("_version", F.lit(r["at"]).cast("bigint"))
        if r["live"] < r["written"]:
            data = data.join(manifest.filter(F.col("at") == r["at"]).select(F.col("key").alias(key)), key, "left_semi").select(*data.columns)
        parts.append(data)
    return reduce(DataFrame.unionByName, parts) if parts else newest


def compact(spark: SparkSession, root: str, key: str) -> int:
    """Publish the newest version's rows as one that needs no other; older versions stay."""

    def write(path: str, number: int) -> None:
        read_features(spark, root, key).drop("_version").write.parquet(f"{path}/data")
        manifest = spark.read.parquet(f"{latest(spark, root)}/manifest").withColumn("at", F.lit(number).cast("bigint"))
        manifest.write.parquet(f"{path}/manifest")
        n = spark.read.parquet(f"{path}/manifest").count()
        rows = [(number, n, n)] if n else []
        spark.createDataFrame(rows, "at bigint, live bigint, written bigint").coalesce(1).write.parquet(f"{path}/parts")

    return publish(spark, root, write)
