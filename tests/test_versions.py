"""Refreshed feature tables and versions that appear whole."""

import os

import pytest
from pyspark.sql import functions as F

from sievework.session import shared_path
from sievework.sources import files, versions


def features(df):
    return df.withColumn("fp", F.size(F.split("text", " ")))


def rows_of(df):
    return sorted((r.id, r.text, r.fp, r._version) for r in df.collect())


def test_refresh_computes_what_changed(spark):
    root = shared_path(spark, "features")
    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        return features(df.mapInArrow(run, df.schema))

    first = spark.range(1000).select("id", F.concat(F.lit("text "), "id").alias("text"), F.timestamp_micros(F.col("id")).alias("t"))
    assert versions.refresh(first, "id", root, counted) == versions.Refresh(1, 1000, 0, 0)
    assert seen.value == 1000
    # Ten rows change, one of them by a microsecond, five go, three come.
    second = first.filter("id >= 5").withColumn("text", F.when(F.col("id") % 100 == 7, F.lit("a b c")).otherwise(F.col("text")))
    second = second.withColumn("t", F.when(F.col("id") == 50, F.timestamp_micros(F.lit(51))).otherwise(F.col("t")))
    second = second.unionByName(spark.range(2000, 2003).select("id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("timestamp").alias("t")))
    assert versions.refresh(second, "id", root, counted) == versions.Refresh(2, 14, 984, 16)
    assert seen.value == 1014
    assert versions.refresh(second.repartition(7), "id", root, counted) == versions.Refresh(3, 0, 998, 0)
    want = sorted((r.id, r.text, r.fp, 2 if r.id >= 2000 or r.id == 50 or r.id % 100 == 7 else 1) for r in features(second).collect())
    assert rows_of(versions.read_features(spark, root, "id")) == want == rows_of(versions.read_features(spark, root, "id", 2))
    # Earlier versions stay readable.
    assert rows_of(versions.read_features(spark, root, "id", 1)) == sorted((r.id, r.text, r.fp, 1) for r in features(first).collect())
    assert versions.compact(spark, root, "id") == 4
    assert rows_of(versions.read_features(spark, root, "id")) == [(*r[:3], 4) for r in want]
    assert versions.refresh(second, "id", root, counted).computed == 0
    assert versions.refresh(second.limit(0), "id", root, counted).dropped == 998
    assert versions.read_features(spark, root, "id").count() == 0


def test_a_write_that_dies_shows_nothing(spark):
    root = shared_path(spark, "features")
    df = spark.range(10).select("id", F.lit("x y").alias("text"))
    versions.refresh(df, "id", root, features)

    def dying(rows):
        return features(rows).withColumn("fp", F.raise_error(F.lit("out of power")).cast("int"))

    with pytest.raises(Exception, match="out of power"):
        versions.refresh(df.withColumn("text", F.lit("z")), "id", root, dying)
    with pytest.raises(ValueError, match="unique"):
        versions.refresh(df.unionByName(df), "id", root, features)
    with pytest.raises(ValueError, match="unique"):
        versions.refresh(df.withColumn("id", F.lit(None).cast("long")), "id", root, features)
    assert versions.versions(spark, root) == [1]
    assert [r[1:] for r in rows_of(versions.read_features(spark, root, "id"))] == [("x y", 2, 1)] * 10


def test_a_version_is_never_replaced(spark):
    root = shared_path(spark, "plain")

    def write(path, number):
        spark.range(number).write.parquet(path)
        if number == 2 and not os.path.exists(versions.version_path(root, 2)):
            # Another writer is faster.
            spark.range(99).write.parquet(versions.version_path(root, 2))

    assert versions.versions(spark, root) == []
    with pytest.raises(FileNotFoundError):
        versions.latest(spark, root)
    assert versions.publish(spark, root, write) == 1
    with pytest.raises(Exception, match="exist"):
        versions.publish(spark, root, write)
    assert spark.read.parquet(versions.latest(spark, root)).count() == 99


def test_csv_fields_with_line_breaks(spark):
    path = shared_path(spark, "quoted") + ".csv"
    rows = [(1, 'two\nlines and "quotes"'), (2, "one")]
    spark.createDataFrame(rows, "id int, text string").coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    got = files.read_csv(spark, path, line_breaks=True).collect()
    assert sorted((int(r.id), r.text) for r in got) == rows
