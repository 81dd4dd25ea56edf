"""Reading structure tables, keeping computed features, and writing results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sievework.functions.features import to_bit_text, to_dense
from sievework.sources import versions

Reader = Callable[[SparkSession, str], DataFrame]

# The columns of the headerless structure list, in file order.
INCHI_SCHEMA = StructType([StructField(c, StringType()) for c in ("toxid", "inchi", "key")])


def read_csv(
    spark: SparkSession, path: str, schema: StructType | None = None, sep: str = ",", line_breaks: bool = False
) -> DataFrame:
    """CSV with a header. Without a schema every column is text, so that the file is not
    read twice to guess types.

    With ``line_breaks`` quoted fields may contain them; every file is then read by one task.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.option("multiLine", line_breaks).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_inchi_tsv(spark: SparkSession, path: str, schema: StructType = INCHI_SCHEMA) -> DataFrame:
    """Tab-separated table without a header, columns named by position."""
    return spark.read.option("sep", "\t").schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# File suffix to reader.
READERS: dict[str, Reader] = {"csv": read_csv, "tsv": read_inchi_tsv, "parquet": read_parquet}


def load_any(spark: SparkSession, path: str) -> DataFrame:
    """Read a table by the suffix of its name."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for {path!r}")
    return READERS[suffix](spark, path)


def load(
    spark: SparkSession,
    path: str,
    reader: Reader = read_csv,
    features: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Read through a caller's reader and add features.

    A Parquet path holds a table whose features have been computed before: it is returned as
    it is.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    df = reader(spark, path)
    return features(df) if features else df


def save_features(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Keep a table with its features for later runs."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def convert_all(
    spark: SparkSession,
    directory: str,
    rules: dict[str, Reader],
    features: Callable[[DataFrame], DataFrame],
    feature: str = "fp",
) -> DataFrame:
    """Read every file of ``directory`` that has a rule, add features, write it as Parquet.

    Returns ``(file, rows, null_features)``. ``x.csv`` becomes ``x.csv.parquet``, so files that
    differ in their extension only stay apart. Files without a rule are left alone; a rule
    applies to the file of exactly that name.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(root))
    reports = []
    for name in names:
        if name not in rules:
            continue
        target = f"{directory.rstrip('/')}/{name}.parquet"
        save_features(features(rules[name](spark, f"{directory.rstrip('/')}/{name}")), target)
        done = spark.read.parquet(target)
        reports.append(
            done.agg(
                F.lit(name).alias("file"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(F.col(feature).isNull()).alias("null_features"),
            )
        )
    if not reports:
        return spark.createDataFrame([], "file string, rows bigint, null_features bigint")
    return reduce(DataFrame.unionByName, reports)


def fingerprint_file(
    spark: SparkSession, source: str, target: str, features: Callable[[DataFrame], DataFrame], n_bits: int
) -> None:
    """Semicolon-separated input to a one-column file of ``'0101...'`` fingerprints."""
    df = features(read_csv(spark, source, sep=";"))
    text = to_bit_text(to_dense(F.col("fp"), n_bits)).alias("fp")
    df.select(text).write.mode("overwrite").option("header", True).csv(target)


def write_predictions(df: DataFrame, path: str) -> None:
    """All columns but the features, as CSV."""
    out = df.drop("fp", "fpcompressed")
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_results(results: dict[str, DataFrame], path: str) -> None:
    """One Parquet dataset per kind of result, partitioned by target."""
    for name, df in results.items():
        df.write.mode("overwrite").partitionBy("target").parquet(f"{path}/{name}")


def publish_best(spark: SparkSession, model: MLWritable, root: str) -> str:
    """Store the winning model as a version of its own and return its path.

    It becomes visible by one rename; ``versions.latest`` finds it, earlier ones stay readable.
    """
    number = versions.publish(spark, root, lambda path, _: model.write().save(path))
    return versions.version_path(root, number)
