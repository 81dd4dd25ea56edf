"""Evaluation of scored rows for all targets and folds in one job.

Input is the long form ``(target, fold, y_true, score)``. Everything is grouped by ``by``
(``target`` and ``fold``), and counts are combined on the map side, so one target holding
most rows is no problem.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.hashing import uniform
from sievework.operators.ranking import running_totals
from sievework.session import materialize

BY = ["target", "fold"]
# Fixed value: keeps balanced accuracy defined when a class is missing.
EPSILON = 1e-10
# Fixed value: scores are clipped to this distance from 0 and 1 before taking logarithms.
CLIP = 1e-7


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# Label counts


def class_counts(long: DataFrame, by: list[str], label: str = "y_true") -> DataFrame:
    """Rows per class."""
    rows = long.filter(F.col(label).isNotNull())
    return rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def imbalance(
    long: DataFrame, by: list[str], label: str = "y_true", allowed: float = 0.1
) -> DataFrame:
    """Class counts and whether the smaller is below ``allowed`` times the larger."""
    n = long.groupBy(*by).agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    )
    least, most = F.least("n0", "n1"), F.greatest("n0", "n1")
    return n.withColumn("imbalanced", least < most * F.lit(allowed))


def share_report(df: DataFrame, label: str, split: str, bits: str) -> DataFrame:
    """Percentage of ones overall, in train and in test, and the share of zero bits."""
    y = F.col(label)
    percent = lambda cond: F.round(
        F.try_divide(F.lit(100.0) * F.count_if(cond & (y == 1)), F.count_if(cond & y.isNotNull()))
    ).cast("bigint")
    zeros = F.size(F.filter(bits, lambda b: ~b))
    return df.agg(
        percent(F.lit(True)).alias("pct_all"),
        percent(F.col(split) == "train").alias("pct_train"),
        percent(F.col(split) == "test").alias("pct_test"),
        F.round(F.try_divide(F.sum(zeros), F.sum(F.size(bits))), 4).alias("zero_share"),
    )


def group_label_stats(
    df: DataFrame, group: str, targets: list[str], k: int = 10, max_targets: int | None = None
) -> DataFrame:
    """Mean and number of labels per target in the k largest groups; all targets by default."""
    cols = targets[:max_targets]
    stats = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("size"),
        *[F.avg(c).alias(f"mean_{c}") for c in cols],
        *[F.count(c).alias(f"n_{c}") for c in cols],
    )
    return stats.orderBy(F.col("size").desc(), F.col(group)).limit(k)


def group_members(df: DataFrame, group: str, member: str) -> DataFrame:
    """Distinct members of every group, one row each, so that no cell grows with a group."""
    return df.select(group, member).distinct()


# Confusion and what follows from it


def confusion(scored: DataFrame, by: list[str] = BY, threshold: float = 0.5) -> DataFrame:
    """tn, fp, fn, tp for ``score >= threshold``."""
    y, hit = F.col("y_true"), F.col("score") >= F.lit(threshold)
    return scored.filter(y.isNotNull() & F.col("score").isNotNull()).groupBy(*by).agg(
        F.count_if((y == 0) & ~hit).alias("tn"),
        F.count_if((y == 0) & hit).alias("fp"),
        F.count_if((y == 1) & ~hit).alias("fn"),
        F.count_if((y == 1) & hit).alias("tp"),
    )


def _counts() -> tuple[Column, Column, Column, Column]:
    return F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")


def class_scores() -> dict[str, Column]:
    """Precision, recall and F1 of both classes from confusion counts; 0 when undefined."""
    tn, fp, fn, tp = _counts()
    return {
        "p_0": _ratio(tn, tn + fn),
        "r_0": _ratio(tn, tn + fp),
        "f1_0": _ratio(2 * tn, 2 * tn + fn + fp),
        "p_1": _ratio(tp, tp + fp),
        "r_1": _ratio(tp, tp + fn),
        "f1_1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def balanced_accuracy() -> Column:
    """Mean of sensitivity and specificity."""
    tn, fp, fn, tp = _counts()
    eps = F.lit(EPSILON)
    return (tp / (tp + fn + eps) + tn / (tn + fp + eps)) / 2


def mcc() -> Column:
    """Matthews correlation, 0 when a margin is empty. In double: the products of four
    counts do not fit into a bigint."""
    tn, fp, fn, tp = (c.cast("double") for c in _counts())
    margins = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return _ratio(tp * tn - fp * fn, margins)


def accuracy() -> Column:
    tn, fp, fn, tp = _counts()
    return _ratio(tp + tn, tn + fp + fn + tp)


def per_class_report(scored: DataFrame, by: list[str] = BY, threshold: float = 0.5) -> DataFrame:
    """One row per class with precision, recall, F1 and support."""
    c = confusion(scored, by, threshold)
    s = class_scores()
    tn, fp, fn, tp = _counts()
    row = lambda label, support: F.struct(
        F.lit(label).alias("class"),
        s[f"p_{label}"].alias("precision"),
        s[f"r_{label}"].alias("recall"),
        s[f"f1_{label}"].alias("f1"),
        support.alias("support"),
    )
    both = F.explode(F.array(row(0, tn + fp), row(1, fn + tp))).alias("r")
    return c.select(*by, both).select(*by, "r.*")


def threshold_scores(scored: DataFrame, by: list[str] = BY, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, balanced accuracy and MCC."""
    s = class_scores()
    return confusion(scored, by, threshold).select(
        *by,
        accuracy().alias("accuracy"),
        s["p_1"].alias("precision"),
        s["r_1"].alias("recall"),
        balanced_accuracy().alias("balanced_accuracy"),
        mcc().alias("mcc"),
    )


# Losses


def clipped(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(1 - CLIP)), F.lit(CLIP))


def cross_entropy(y: Column, score: Column) -> Column:
    p = clipped(score)
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def focal(y: Column, score: Column, gamma: float = 2.0) -> Column:
    p = clipped(score)
    hit = y * p + (1 - y) * (1 - p)
    return -F.pow(1 - hit, F.lit(gamma)) * F.log(hit)


def squared_error(y: Column, score: Column) -> Column:
    return (y - score) * (y - score)


def losses(scored: DataFrame, by: list[str] = BY, gamma: float = 2.0) -> DataFrame:
    """Mean cross-entropy, squared error and focal loss."""
    y, s = F.col("y_true"), F.col("score")
    rows = scored.filter(y.isNotNull() & s.isNotNull())
    return rows.groupBy(*by).agg(
        F.avg(cross_entropy(y, s)).alias("bce"),
        F.avg(squared_error(y, s)).alias("mse"),
        F.avg(focal(y, s, gamma)).alias("focal"),
    )


def regression_scores(df: DataFrame, y: str, predicted: str, by: list[str]) -> DataFrame:
    """rmse, mae, mse and r2 in one pass, over rows that have both values."""
    t, p = F.col(y).cast("double"), F.col(predicted).cast("double")
    t = F.when(p.isNotNull(), t)
    mse = F.avg((t - p) * (t - p))
    return df.groupBy(*by).agg(
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(t - p)).alias("mae"),
        mse.alias("mse"),
        (1 - F.try_divide(F.sum((t - p) * (t - p)), F.var_pop(t) * F.count(t))).alias("r2"),
    )


# Curves


def _by_score(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per distinct score the positives and negatives, with running counts from the top.

    Equal scores are counted together before anything is ordered, so ties cost nothing.
    """
    y, s = F.col("y_true"), F.col("score")
    per_score = scored.filter(y.isNotNull() & s.isNotNull()).groupBy(*by, "score").agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    # Read three times below; scoring may be expensive, so it is done once.
    per_score = materialize(per_score, "scores")
    return running_totals(
        per_score, {"tp": F.col("pos"), "fp": F.col("neg")}, "score", partition=by, descending=True
    )


def roc_curve(scored: DataFrame, by: list[str] = BY) -> DataFrame:
    """One point per distinct score, without the origin."""
    points = _by_score(scored, by)
    totals = points.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return points.join(totals, by).select(
        *by,
        "score",
        F.try_divide(F.col("fp").cast("double"), F.col("N")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("tpr"),
    )


def auc(scored: DataFrame, by: list[str] = BY) -> DataFrame:
    """Area under the ROC curve by trapezoids; null when a class is missing.

    The trapezoid of a score has width ``neg`` and mean height ``tp - pos / 2``.
    """
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    sums = _by_score(scored, by).groupBy(*by).agg(
        area.alias("area"), F.sum("pos").alias("P"), F.sum("neg").alias("N")
    )
    return sums.select(
        *by, F.try_divide(F.col("area"), F.col("P").cast("double") * F.col("N")).alias("auc")
    )


def binned_auc(scored: DataFrame, by: list[str] = BY, bins: int = 200) -> DataFrame:
    """AUC over ``bins`` equal score ranges: approximate, needs no ordering of the scores."""
    # least() would turn a missing score into the top one.
    known = scored.filter(F.col("score").isNotNull())
    binned = known.withColumn("score", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)))
    return auc(binned, by)


def average_precision(scored: DataFrame, by: list[str] = BY) -> DataFrame:
    """Area under the precision-recall curve, as the step sum over distinct scores."""
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return _by_score(scored, by).groupBy(*by).agg(
        F.try_divide(F.sum(step), F.sum("pos").cast("double")).alias("prc_auc")
    )


# Several targets at once


def weighted_f1(scored: DataFrame, by: list[str], target: str = "target") -> DataFrame:
    """Mean over targets of the F1 of class 1, weighted by its support.

    Scores are rounded half to even, so 0.5 counts as 0.
    """
    rounded = scored.withColumn("score", F.rint("score"))
    c = confusion(rounded, [*by, target])
    f1, support = class_scores()["f1_1"], F.col("tp") + F.col("fn")
    return c.groupBy(*by).agg(_ratio(F.sum(f1 * support), F.sum(support)).alias("f1"))


def against_baseline(scored: DataFrame, key: str, by: list[str], seed: int = 0) -> DataFrame:
    """F1 of the model next to that of repeatable random scores."""
    random_scores = scored.withColumn(
        "score", uniform(F.concat_ws("|", F.col("target"), F.col(key)), seed)
    )
    trained = weighted_f1(scored, by).withColumnRenamed("f1", "f1_trained")
    untrained = weighted_f1(random_scores, by).withColumnRenamed("f1", "f1_random")
    return trained.join(untrained, by)


def fold_summary(scores: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Mean and population standard deviation of each metric over folds."""
    return scores.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in cols],
    )


def evaluation(scored: DataFrame, by: list[str] = BY, threshold: float = 0.5) -> DataFrame:
    """One row per target and fold: class scores, loss, accuracies, MCC and AUC.

    Everything but the loss follows from counts per distinct score, and the loss of such a
    row is its count times the loss of its score. So the scored rows are read once and
    shuffled once, already aggregated.
    """
    points = _by_score(scored, by)
    hit = F.col("score") >= F.lit(threshold)
    loss = cross_entropy(F.lit(1.0), F.col("score")) * F.col("pos") + cross_entropy(
        F.lit(0.0), F.col("score")
    ) * F.col("neg")
    sums = points.groupBy(*by).agg(
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(loss).alias("loss_sum"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)).alias("area"),
    )
    tn, fp, fn, tp = _counts()
    n = tn + fp + fn + tp
    return sums.select(
        *by,
        *[c.alias(name) for name, c in class_scores().items()],
        (F.col("loss_sum") / n).alias("loss"),
        accuracy().alias("accuracy"),
        balanced_accuracy().alias("balanced_accuracy"),
        mcc().alias("mcc"),
        F.try_divide(F.col("area"), (tp + fn).cast("double") * (tn + fp)).alias("auc"),
    )


def mean_score(predictions: list[DataFrame], keys: list[str]) -> DataFrame:
    """Ensemble: mean score per key over the predictions of several models."""
    stacked = reduce(DataFrame.unionByName, predictions)
    return stacked.groupBy(*keys).agg(F.avg("score").alias("score"))
