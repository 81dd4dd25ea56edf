import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.operators.ranking import running_totals, spread_join, value_buckets


def skewed(spark, n=3000):
    """A third of all rows share one value, some have none."""
    value = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 50 == 1, None).otherwise(
        F.col("id") * 37 % 1000 / 10.0
    )
    return spark.range(n).select("id", value.alias("v"), (F.col("id") % 4 == 0).cast("int").alias("p"))


@pytest.mark.parametrize("descending", [False, True])
def test_rank_equals_sorting(spark, descending):
    df = skewed(spark).filter("v is not null")
    got = running_totals(df, {"r": F.lit(1)}, "v", "id", descending=descending).toPandas()
    want = got.sort_values(["v", "id"], ascending=not descending)
    assert want["r"].tolist() == list(range(1, len(want) + 1))


def test_running_sum_per_partition(spark):
    df = skewed(spark).filter("v is not null")
    got = running_totals(df, {"s": F.col("id")}, "v", "id", ["p"]).toPandas()
    for _, part in got.groupby("p"):
        part = part.sort_values(["v", "id"])
        assert part["s"].tolist() == part["id"].cumsum().tolist()


def test_no_bucket_keeps_a_hot_value(spark):
    df = value_buckets(skewed(spark).filter("v is not null"), "v", "id", n=30)
    sizes = df.groupBy("_b").count().toPandas()["count"]
    assert sizes.max() < 3 * sizes.sum() / 30


def test_timestamps_without_zone(spark):
    df = spark.sql(
        "select id, timestamp_ntz'2024-03-31 01:00:00' + make_interval(0,0,0,0,0,id * 7 % 500) as t from range(500)"
    )
    got = running_totals(df, {"r": F.lit(1)}, "t", "id").toPandas().sort_values(["t", "id"])
    assert got["r"].tolist() == list(range(1, 501))


def test_empty_and_constant(spark):
    empty = spark.createDataFrame([], "id bigint, v double")
    assert running_totals(empty, {"r": F.lit(1)}, "v", "id").count() == 0
    same = spark.range(100).withColumn("v", F.lit(1.0))
    got = running_totals(same, {"r": F.lit(1)}, "v", "id").toPandas().sort_values("id")
    assert got["r"].tolist() == list(range(1, 101))


def test_spread_join_hot_null_and_rare_keys(spark):
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("k")
    )
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size")).withColumn(
        "tag", F.concat(F.lit("t"), F.coalesce(F.col("k").cast("string"), F.lit("-")))
    )
    got = spread_join(rows, groups, "k", "id", "size", ["tag"]).toPandas()
    assert len(got) == 5000
    want = got["k"].map(lambda k: "t-" if pd.isna(k) else f"t{int(k)}")
    assert (got["tag"] == want).all()


@pytest.mark.parametrize("descending", [False, True])
def test_text_rank_equals_sorting(spark, descending):
    text = F.concat(F.element_at(F.lit(["", "k", "Zé", "日本", "common-prefix-"]), F.col("id").cast("int") % 5 + 1), F.md5(F.col("id").cast("string")))
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(text).alias("t"))
    got = running_totals(df, {"r": F.lit(1)}, "t", "id", descending=descending).toPandas()
    place = got["t"].map(str.encode)
    want = got.assign(t=place).sort_values(["t", "id"], ascending=not descending)
    assert want["r"].tolist() == list(range(1, 2001))


def test_no_bucket_keeps_a_hot_text(spark):
    rows = spark.range(6000).select(
        F.concat(F.lit("key-"), F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("t"),
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.rand(1)).alias("w"),
    )
    for value in ("t", "w"):
        sizes = value_buckets(rows, value, "k", n=30).groupBy("_b").count().toPandas()["count"]
        assert sizes.max() < 3 * 6000 / 30


def test_text_bounds_of_empty_null_and_constant(spark):
    assert running_totals(spark.createDataFrame([], "k string"), {"r": F.lit(1)}, "k").count() == 0
    for text in (F.lit("x"), F.lit(None).cast("string"), F.lit("")):
        df = spark.range(50).withColumn("t", text)
        got = running_totals(df, {"r": F.lit(1)}, "t", "id").toPandas().sort_values("id")
        assert got["r"].tolist() == list(range(1, 51))
