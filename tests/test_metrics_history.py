import math
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import history, metrics


def scored(spark, n=500, levels=20, only=None):
    r = random.Random(3)
    rows = [("t", 1, r.randint(0, 1) if only is None else only, r.randrange(levels) / levels) for _ in range(n)]
    return spark.createDataFrame(rows, "target string, fold int, y_true int, score double"), rows


def test_auc_is_the_share_of_ordered_pairs(spark):
    df, rows = scored(spark)
    pos, neg = [s for *_, y, s in rows if y], [s for *_, y, s in rows if not y]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert metrics.auc(df).first()["auc"] == pytest.approx(wins)
    assert metrics.evaluation(df).first()["auc"] == pytest.approx(wins)


def test_evaluation_agrees_with_the_single_metrics(spark):
    df, _ = scored(spark)
    row = metrics.evaluation(df).first()
    one = metrics.threshold_scores(df).first()
    for c in ("accuracy", "balanced_accuracy", "mcc"):
        assert row[c] == pytest.approx(one[c])
    assert row["loss"] == pytest.approx(metrics.losses(df).first()["bce"])


def test_all_scores_tied(spark):
    df, _ = scored(spark, levels=1)
    assert metrics.auc(df).first()["auc"] == pytest.approx(0.5)
    assert metrics.roc_curve(df).count() == 1


def test_one_class_only_has_no_auc(spark):
    df, _ = scored(spark, only=1)
    row = metrics.evaluation(df).first()
    assert row["auc"] is None and row["mcc"] == 0 and row["p_0"] == 0


def test_no_rows(spark):
    df, _ = scored(spark, n=1)
    assert metrics.evaluation(df.limit(0)).count() == 0


def long_runs(spark, n=2500):
    r = random.Random(5)
    rows = [(run, i, r.random() * 100 / (1 + i / 50)) for run in (1, 2) for i in range(n if run == 1 else 7)]
    return spark.createDataFrame(rows, "run int, epoch bigint, v double"), rows


@pytest.mark.parametrize("factor", [0.2, 0.5, 0.8])
def test_smoothing_over_many_chunks(spark, factor):
    df, rows = long_runs(spark)
    got = {(r["run"], r["epoch"]): r["smoothed"] for r in history.smooth(df, "run", "epoch", "v", factor).collect()}
    s = None
    for run, i, v in rows:
        s = v if i == 0 else s * factor + v * (1 - factor)
        assert got[run, i] == pytest.approx(s, rel=1e-9)


@pytest.mark.parametrize("chunk", [5, 64, 4096])
def test_early_stop_in_chunks(spark, chunk):
    df, rows = long_runs(spark, 300)
    got = {r["run"]: r for r in history.early_stop(df, "run", "epoch", "v", 20, 0.01, chunk).collect()}
    for run in (1, 2):
        best, best_epoch, wait, stop = None, None, 0, None
        for _, i, v in (r for r in rows if r[0] == run):
            if best is None or v < best - 0.01:
                best, best_epoch, wait = v, i, 0
            else:
                wait += 1
            if wait >= 20:
                stop = i
                break
        assert (got[run]["best"], got[run]["best_epoch"], got[run]["stop_epoch"]) == (best, best_epoch, stop)


def test_epochs_of_a_hot_run(spark):
    events = spark.range(2000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 100).alias("run"),
        (F.col("id") * 7 % 2000).alias("t"), "id",
    )
    got = history.number_epochs(events, "run", "t", "id").toPandas()
    for _, part in got.groupby("run"):
        assert part.sort_values(["t", "id"])["epoch"].tolist() == list(range(len(part)))


def test_missing_scores_are_left_out(spark):
    df, _ = scored(spark)
    holes = df.withColumn("score", F.when(F.col("score") < 0.9, F.col("score")))
    kept = df.filter("score < 0.9")
    for metric in (metrics.auc, metrics.evaluation, metrics.binned_auc):
        assert metric(holes).collect() == metric(kept).collect()


def test_undefined_ratios_are_null(spark):
    df = spark.createDataFrame([(1, 1, [True]), (2, 0, [False])], "id bigint, y int, b array<boolean>")
    row = metrics.share_report(df.withColumn("split", F.lit("train")), "y", "split", F.col("b")).first()
    assert row["pct_train"] == 50 and row["pct_test"] is None and row["zero_share"] == 0.5
    flat = metrics.regression_scores(df.withColumn("t", F.lit(1.0)), "t", "y", []).first()
    assert flat["r2"] is None and flat["mae"] == 0.5


@pytest.mark.parametrize("factor", [0.3, 0.8])
def test_smoothing_with_gaps_holes_and_large_values(spark, factor):
    """Long runs, null among them: a missing epoch, null and NaN values, numbers of every size."""
    n, rows = 2600, []
    for run in (None, 1):
        for i in range(n):
            v = None if i % 11 == 0 else math.nan if i % 13 == 0 else 1e300 if i == 5 else 1e150 if i == 40 else float(i % 9)
            if i != 700:
                rows.append((run, i, v))
    df = spark.createDataFrame(rows, "run int, epoch bigint, v double")
    got = {(r["run"], r["epoch"]): r["smoothed"] for r in history.smooth(df, "run", "epoch", "v", factor).collect()}
    assert len(got) == len(rows)
    last = {}
    for run, i, v in rows:
        if v is None or math.isnan(v):
            assert got[run, i] is None
            continue
        last[run] = v if run not in last else last[run] * factor + v * (1 - factor)
        assert got[run, i] == pytest.approx(last[run], rel=1e-9)
