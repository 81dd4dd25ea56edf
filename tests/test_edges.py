"""Cases with nulls, separators, gaps and equal names."""

import math

import pytest
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from sievework.operators import dedup, frame, history, metrics, splits
from sievework.plans.catalog import QUERIES
from sievework.sources import files


def test_duplicates_are_told_apart(spark):
    rows = [(1, ["a, b"], "x"), (2, ["a", "b"], "x"), (3, ["a", "b"], "x"), (4, None, "x"), (5, None, "x"), (None, ["a", "b"], "x")]
    df = spark.createDataFrame(rows, "k long, a array<string>, b string")
    kept = sorted(r.k or 0 for r in dedup.remove_duplicates(df, "k", ["a", "b"]).collect())
    assert kept == [0, 1, 2, 4]
    df = spark.createDataFrame([(1, "a\x1fb", "c"), (2, "a", "b\x1fc"), (3, None, "c"), (4, "\x00null", "c")], "k long, a string, b string")
    assert dedup.remove_duplicates(df, "k", ["a", "b"]).count() == 4


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_timestamps_a_microsecond_apart_are_no_copies(spark, kind):
    rows = [(1, "2024-01-02 03:04:05.123456"), (2, "2024-01-02 03:04:05.123457"), (3, "2024-01-02 03:04:05.123457"), (4, "2024-01-02 03:04:05"), (5, None)]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("t", F.col("t").cast(kind))
    df = df.withColumn("nested", F.array(F.struct("t"))).withColumn("y", F.lit(1))
    for cols in (["t"], ["nested"]):
        assert sorted(r.k for r in dedup.remove_duplicates(df, "k", cols).collect()) == [1, 2, 4, 5]
        assert sorted(r.k for r in dedup.prepare_task(df, "k", cols, "y").collect()) == [1, 2, 4, 5]


@pytest.mark.parametrize("name", ["m2_shallow_network", "m4_score_trained_model"])
def test_models_score_a_held_out_part(spark, monkeypatch, name):
    seen = []
    fit = Estimator.fit
    monkeypatch.setattr(Estimator, "fit", lambda self, df, *a: seen.append(df) or fit(self, df, *a))
    scored = {r.vec_id for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    assert len(seen) == 1 and scored
    assert not scored & {r.vec_id for r in seen[0].select("vec_id").collect()}


def test_regression_skips_missing_predictions(spark):
    df = spark.createDataFrame([(1, 1.0, 1.5), (1, 2.0, 2.0), (1, 4.0, 3.0), (1, 900.0, None)], "g int, y double, p double")
    got = metrics.regression_scores(df, "y", "p", ["g"]).first()
    mean = 7 / 3
    assert got.r2 == pytest.approx(1 - 1.25 / sum((v - mean) ** 2 for v in (1, 2, 4)))


def test_missing_losses_are_never_best(spark):
    rows = [(1, 0, None), (1, 1, math.nan), (1, 2, 0.5), (1, 3, 0.4), (1, 4, None), (1, 5, 0.9)]
    df = spark.createDataFrame(rows, "run int, epoch long, loss double")
    assert history.best_epoch(df, "run", "epoch", "loss").first().epoch == 3
    saved = history.checkpoints(df, "run", "epoch", "loss", 1).first()
    assert (saved.saved_epoch, saved.saved_value) == (3, 0.4)
    assert history.early_stop(df, "run", "epoch", "loss", patience=50).first().best_epoch == 3


def test_null_group_finds_a_place(spark):
    df = spark.createDataFrame([(k, f"g{k % 6}" if k % 3 else None) for k in range(90)], "k long, g string")
    got = splits.balanced_group_split(df, "g", "k", (0.6, 0.0, 0.4)).collect()
    assert len(got) == 90


def test_all_targets_by_default(spark):
    names = [f"t{i}" for i in range(25)]
    df = spark.createDataFrame([(1, *range(25))], ["g", *names])
    assert "mean_t24" in metrics.group_label_stats(df, "g", names).columns


def test_equal_stems_stay_apart(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a\n1\n")
    (tmp_path / "x.tsv").write_text("a\n1\n2\n")
    rule = lambda s, path: s.read.option("header", True).csv(path).withColumnRenamed("a", "fp")
    got = files.convert_all(spark, str(tmp_path), {"x.csv": rule, "x.tsv": rule}, lambda df: df)
    assert sorted((r.file, r.rows) for r in got.collect()) == [("x.csv", 1), ("x.tsv", 2)]


def test_text_keys_and_null_groups_in_group_splits(spark):
    rows = [(f"id{k:03}", f"g{k % 6}" if k % 3 else None) for k in range(90)]
    df = spark.createDataFrame(rows, "k string, g string")
    got = splits.group_split(df, "g", "k", (0.6, 0.0, 0.4)).collect()
    assert len(got) == 90 and all(r.split for r in got)
    places = {}
    for r in got:
        places.setdefault(r.g, set()).add(r.split)
    assert all(len(p) == 1 for p in places.values())
    assert sorted(r["index"] for r in frame.reindex(df, "k").collect()) == list(range(90))
