import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import splits


def frame(spark, n, zeros=0.7, seed=1):
    r = random.Random(seed)
    rows = [(i, None if r.random() < 0.1 else int(r.random() > zeros), r.random()) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, y int, w double")


def sequential(sizes, order, test, train):
    """The plain loop: group after group into test, else train, else val."""
    total = sum(sizes.values())
    room = {"test": test * total + 1e-9, "train": train * total + 1e-9}
    out = {}
    for g in order:
        for name in ("test", "train"):
            if sizes[g] <= room[name]:
                room[name] -= sizes[g]
                out[g] = name
                break
        else:
            out[g] = "val"
    return out


def grouped(spark, sizes):
    rows = [(g, i) for i, g in enumerate(g for g, s in sizes.items() for _ in range(s))]
    return spark.createDataFrame(rows, "g bigint, id bigint"), rows


CASES = [
    {g: random.Random(g).randint(1, 30) for g in range(120)},
    {0: 400, **{g: 1 + g % 5 for g in range(1, 200)}},  # one group holds almost half
    {g: 1 for g in range(50)},
    {0: 10},
]


@pytest.mark.parametrize("sizes", CASES)
@pytest.mark.parametrize("shares", [(0.8, 0.0, 0.2), (0.5, 0.3, 0.2)])
def test_group_split_equals_sequential_fill(spark, sizes, shares):
    df, rows = grouped(spark, sizes)
    first = {}
    for g, i in rows:
        first.setdefault(g, i)
    order = sorted(sizes, key=lambda g: (-sizes[g], first[g]))
    want = sequential(sizes, order, shares[2], shares[0])
    got = splits.group_split(df, "g", "id", shares).collect()
    assert len(got) == len(rows)
    assert all(r["split"] == want[r["g"]] for r in got)


@pytest.mark.parametrize("sizes", CASES)
def test_balanced_folds_equal_sequential_fill(spark, sizes):
    df, rows = grouped(spark, sizes)
    got = splits.repeated_group_folds(df, "g", "id", [1, 2], (0.7, 0.1, 0.2)).collect()
    assert len(got) == 2 * len(rows)
    total = len(rows)
    for seed in (1, 2):
        big = lambda g: sizes[g] > 0.1 * total / 2 + 1e-9 or sizes[g] > 0.2 * total / 2 + 1e-9
        digest = lambda g: hashlib.md5(f"{seed}|{g}".encode()).hexdigest()
        order = sorted(sizes, key=lambda g: (not big(g), digest(g)))
        want = sequential(sizes, order, 0.2, 0.7)
        assert all(r["split"] == want[r["g"]] for r in got if r["seed"] == seed)


@pytest.mark.parametrize("f", [0.5, 1.0, 2.0, 3.0])
def test_down_sample_ratio(spark, f):
    df = frame(spark, 6000)
    counts = {r["y"]: r["count"] for r in splits.down_sample(df, "id", "y", f).groupBy("y").count().collect()}
    have = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    assert counts[1] == have[1]
    assert counts[0] == math.floor(min(have[0], have[1] / f))
    if have[1] / f <= have[0]:
        assert abs(counts[1] / counts[0] - f) < 0.01


def test_stratified_folds_test_each_row_once(spark):
    got = splits.stratified_k_fold(frame(spark, 1003), "id", "y", 4).toPandas()
    assert got["id"].is_unique
    assert set(got["fold"]) == {1, 2, 3, 4}
    assert got["fold"].value_counts().max() - got["fold"].value_counts().min() <= 1
    per_class = got.groupby(["y", "fold"]).size().unstack()
    assert (per_class.max(axis=1) - per_class.min(axis=1) <= 1).all()


def test_k_fold_sizes(spark):
    got = splits.k_fold(spark.range(103), "id", 4).toPandas()["fold"].value_counts()
    assert got.to_dict() == {1: 26, 2: 26, 3: 26, 4: 25}


def test_weight_split_puts_light_rows_into_train(spark):
    df = frame(spark, 1000).withColumn("w", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("w")))
    got = splits.weight_split(df, "id", "w", (0.7, 0.1, 0.2)).toPandas()
    assert got["split"].value_counts().to_dict() == {"train": 700, "test": 200, "val": 100}
    order = got.sort_values(["w", "id"])["split"].tolist()
    assert order == ["train"] * 700 + ["val"] * 100 + ["test"] * 200
    big = splits.weight_split(df, "id", "w", (0.7, 0.1, 0.2), "big").toPandas()
    assert big[big["split"] == "train"]["w"].min() >= big[big["split"] == "test"]["w"].max()


def test_weights_missing_come_off_the_test_part(spark):
    df = spark.range(100).withColumn("w", F.when(F.col("id") >= 10, F.col("id").cast("double")))
    got = splits.weight_split(df, "id", "w", (0.8, 0.0, 0.2)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 80, "test": 10}


def test_random_split_sizes_and_empty_test_part(spark):
    df = spark.range(11)
    assert splits.random_split(df, "id", 0.25).filter("split = 'test'").count() == 3
    assert splits.random_split(df, "id", 0.0).filter("split = 'test'").count() == 0
    assert splits.random_split(df.limit(0), "id", 0.2).count() == 0


def test_one_class_only(spark):
    df = spark.range(20).withColumn("y", F.lit(1))
    assert splits.stratified_split(df, "id", "y", 0.2).filter("split = 'test'").count() == 4
    assert splits.down_sample(df, "id", "y", 0.5).count() == 20


def test_imbalanced_target_is_sampled_at_a_tenth(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") < 20).cast("int"))
    assert splits.prepare_target(df, "id", "y", 0.5).count() == 20 + 200
    assert splits.prepare_target(df, "id", "y", None).count() == 1000


def test_wrong_parameters(spark):
    df = spark.range(3).withColumn("y", F.lit(1))
    with pytest.raises(ValueError):
        splits.random_split(df, "id", 0.6)
    with pytest.raises(ValueError):
        splits.k_fold(df, "id", 1)
    with pytest.raises(ValueError):
        splits.group_split(df, "y", "id", (0.5, 0.2, 0.2))
    with pytest.raises(ValueError):
        splits.weight_split(df, "id", "y", (0.8, 0.0, 0.2), "heavy")
    with pytest.raises(ValueError):
        splits.down_sample(df, "id", "y", 0)


def test_strata_of_every_size(spark):
    """More strata than any list should hold, one of them with a third of all rows."""
    n = 150_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("s"))
    got = splits.stratified_split(df, "id", "s", 0.2)
    tests = {r["hot"]: r["t"] for r in got.groupBy((F.col("s") == "hot").alias("hot")).agg(F.count_if(F.col("split") == "test").alias("t")).collect()}
    assert tests == {True: n // 15, False: n - n // 3}
    folds = splits.stratified_k_fold(df, "id", "s", 3).groupBy("fold").count()
    assert {r["fold"]: r["count"] for r in folds.collect()} == dict.fromkeys((1, 2, 3), n // 3)


def test_strata_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, s string")
    assert splits.stratified_split(df, "id", "s", 0.2).count() == 0
    assert splits.stratified_k_fold(df, "id", "s", 3).count() == 0
