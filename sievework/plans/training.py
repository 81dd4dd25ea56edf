"""Training, scoring and tuning of classifiers with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.frame import complete_cases
from sievework.operators.metrics import against_baseline, evaluation
from sievework.operators.reduce import as_vector
from sievework.operators.splits import (
    balanced_group_split,
    group_folds,
    k_fold,
    prepare_target,
    stratified_k_fold,
    stratified_split,
    weight_split,
)
from sievework.session import materialize

Maker = Callable[[], Estimator]
# Fixed value: depth and width of the shallow network.
SHALLOW = [50] * 8
#: Fits that run side by side.
PARALLEL = 4


def halving_layers(width: int) -> list[int]:
    """Network whose hidden layers halve in width: ``int(log2(width) / 2 - 1)`` of them."""
    hidden = max(int(math.log2(width) / 2 - 1), 0)
    return [width, *[width // 2 ** (i + 1) for i in range(hidden)], 2]


def shallow_layers(width: int) -> list[int]:
    return [width, *SHALLOW, 2]


def network(layers: list[int], iterations: int = 50, seed: int = 42, weight: str | None = None) -> Estimator:
    """Multilayer perceptron on columns ``features`` and ``label``."""
    if weight:
        raise ValueError("the network takes no row weights; use logistic")
    return MultilayerPerceptronClassifier(layers=layers, maxIter=iterations, seed=seed, blockSize=128)


def logistic(iterations: int = 50, reg: float = 0.0, weight: str | None = None) -> Estimator:
    """Logistic regression, the fast choice for wide sparse fingerprints."""
    model = LogisticRegression(maxIter=iterations, regParam=reg)
    return model.setWeightCol(weight) if weight else model


def score(df: DataFrame, model: Model, feature: str = "features") -> DataFrame:
    """Add ``score`` to the rows that have features; the others are dropped. Map-only."""
    rows = model.transform(df.filter(F.col(feature).isNotNull()))
    probability = F.get(vector_to_array("probability"), F.lit(1))
    return rows.withColumn("score", probability).drop("rawPrediction", "probability", "prediction")


def _long(df: DataFrame, key: str, target: str, fold: int) -> DataFrame:
    return df.select(
        F.col(key).alias("id"),
        F.lit(target).alias("target"),
        F.lit(fold).alias("fold"),
        F.col("label").cast("int").alias("y_true"),
        "score",
    )


def target_folds(
    df: DataFrame, key: str, target: str, split_type: str, folds: int, test_size: float, seed: int,
    group: str | None = None, weight: str | None = None,
) -> tuple[DataFrame, list[int]]:
    """Rows with a column ``split_<fold>`` per fold, and the fold numbers.

    ``random`` cuts stratified folds, ``group`` keeps groups together with one seed per
    fold, ``weight`` trains on light rows and tests on heavy ones and allows one fold only.
    A single split is fold 0. Rows are never repeated, however many folds there are.
    """
    sizes = (1 - test_size, 0.0, test_size)
    if folds < 1:
        raise ValueError("at least one fold is needed")
    numbers = list(range(1, folds + 1)) if folds > 1 else [0]
    if split_type == "random" and folds == 1:
        placed = stratified_split(df, key, target, test_size, seed)
    elif split_type == "random":
        placed = stratified_k_fold(df, key, target, folds, seed)
        tag = lambda f: F.when(F.col("fold") == f, "test").otherwise("train").alias(f"split_{f}")
        return placed.select(*df.columns, *[tag(f) for f in numbers]), numbers
    elif split_type == "group" and folds == 1:
        placed = balanced_group_split(df, group, key, sizes, seed)
    elif split_type == "group":
        placed = group_folds(df, group, key, numbers, sizes)
        tag = lambda f: F.get("folds", F.lit(f - 1))["split"].alias(f"split_{f}")
        return placed.select(*df.columns, *[tag(f) for f in numbers]), numbers
    elif split_type == "weight":
        if folds > 1:
            raise ValueError("a weight split has one fold")
        placed = weight_split(df, key, weight, sizes, "small")
    else:
        raise ValueError(f"unknown split type {split_type!r}")
    return placed.withColumnRenamed("split", "split_0"), numbers


def train_single(
    df: DataFrame, key: str, feature: str, targets: list[str], make: Maker, split_type: str = "random",
    folds: int = 1, test_size: float = 0.2, fraction: float | None = None, seed: int = 42,
    group: str | None = None, weight: str | None = None,
) -> tuple[DataFrame, dict[str, tuple[int, Model]]]:
    """One binary classifier per target and fold.

    ``df`` should be a stored feature table (``save_features``), so that features are not
    computed again for every target. Targets are prepared on their own: rows with a label
    and the feature, sampled if asked. Returns the scored test rows of all targets and folds, which ``evaluation`` turns
    into one table in one job, and the best fold's model of every target.
    """
    scored: list[DataFrame] = []
    models: dict[tuple[str, int], Model] = {}
    for target in targets:
        extra = [c for c in (group, weight) if c]
        rows = as_vector(df, feature).select(key, "features", F.col(target).cast("double").alias("label"), *extra)
        rows = prepare_target(rows, key, "label", fraction, seed)
        placed, numbers = target_folds(
            rows, key, "label", split_type, folds, test_size, seed, group, weight
        )
        # Read by every fit and every scoring of this target.
        placed = materialize(placed, "folds")
        for fold in numbers:
            tag = F.col(f"split_{fold}")
            model = make().fit(placed.filter(tag == "train"))
            models[target, fold] = model
            scored.append(_long(score(placed.filter(tag == "test"), model), key, target, fold))
    predictions = materialize(reduce(DataFrame.unionByName, scored), "predictions")
    order = F.struct("p_1", "r_1", "mcc", -F.col("fold"))
    # One row per target.
    best = evaluation(predictions).groupBy("target").agg(F.max_by("fold", order).alias("fold")).collect()
    return predictions, {r["target"]: (r["fold"], models[r["target"], r["fold"]]) for r in best}


def train_multi(
    df: DataFrame, key: str, feature: str, targets: list[str], make: Maker, folds: int, seed: int = 42
) -> tuple[DataFrame, int, dict[str, Model]]:
    """All targets on the same folds, rows with every target only.

    Returns one row per fold with the weighted F1 of the trained and of an untrained model,
    the best fold, and models refitted on all rows. Spark ML has no network with several
    outputs, so a fold is one model per target.
    """
    rows = as_vector(complete_cases(df, targets), feature).select(key, "features", *targets)
    placed = materialize(k_fold(rows, key, folds, seed), "folds")
    parts = []
    for fold in range(1, folds + 1):
        for target in targets:
            data = placed.withColumn("label", F.col(target).cast("double"))
            model = make().fit(data.filter(F.col("fold") != fold))
            parts.append(_long(score(data.filter(F.col("fold") == fold), model), key, target, fold))
    predictions = materialize(reduce(DataFrame.unionByName, parts), "predictions")
    table = against_baseline(predictions, "id", ["fold"], seed)
    best = table.agg(F.max_by("fold", F.struct("f1_trained", -F.col("fold")))).first()[0]
    final = {
        t: make().fit(rows.withColumn("label", F.col(t).cast("double"))) for t in targets
    }
    return table, best, final


def separate_models(
    placed: DataFrame, key: str, feature: str, targets: list[str], folds: int, make: Maker, fold: str = "fold"
) -> DataFrame:
    """Scored test rows of one model per target and fold, each trained on the rows that have its
    label; fits run side by side, a few at a time."""
    rows = as_vector(placed, feature)

    def one(job: tuple[str, int]) -> DataFrame:
        target, k = job
        data = rows.filter(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double"))
        model = make().fit(data.filter(F.col(fold) != k))
        return _long(score(data.filter(F.col(fold) == k), model), key, target, k)

    with ThreadPoolExecutor(PARALLEL) as pool:
        parts = list(pool.map(one, [(t, k) for t in targets for k in range(1, folds + 1)]))
    return reduce(DataFrame.unionByName, parts)


def fit_and_evaluate(train: DataFrame, test: DataFrame, key: str, make: Maker, target: str, fold: int = 0) -> tuple[Model, DataFrame]:
    """Fit on one part, evaluate on the other: the model and its evaluation row."""
    model = make().fit(train)
    return model, evaluation(_long(score(test, model), key, target, fold))


def grid_search(
    df: DataFrame, base: Estimator, grid: dict[str, list], key: str, folds: int = 3, seed: int = 42, parallelism: int = 4
) -> tuple[CrossValidatorModel, DataFrame]:
    """Cross-validated search over all combinations; one row per setting.

    Folds are those of ``k_fold`` by ``key``, so they are the same in every layout of the table.
    """
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(base.getParam(name), values)
    settings = builder.build()
    search = CrossValidator(
        estimator=base, estimatorParamMaps=settings, evaluator=BinaryClassificationEvaluator(),
        numFolds=folds, seed=seed, parallelism=parallelism, foldCol="_fold",
    )
    # Read by every fit; folds count from 0 here.
    placed = materialize(k_fold(df, key, folds, seed).withColumn("_fold", F.col("fold") - 1), "folds")
    search = search.fit(placed)
    rows = [
        (" ".join(f"{p.name}={v}" for p, v in sorted(s.items(), key=lambda x: x[0].name)), float(m), float(d))
        for s, m, d in zip(settings, search.avgMetrics, search.stdMetrics)
    ]
    table = df.sparkSession.createDataFrame(rows, "setting string, mean double, std double")
    return search, rank_settings(table)


def tune_in_stages(
    df: DataFrame, base: Estimator, stages: list[dict[str, list]], key: str, folds: int = 3, seed: int = 42
) -> tuple[Estimator, DataFrame]:
    """Tune one group of parameters, fix the best, go on with the next."""
    tables = []
    for i, grid in enumerate(stages):
        search, table = grid_search(df, base, grid, key, folds, seed)
        values = {p.name: v for p, v in search.bestModel.extractParamMap().items()}
        base = base.copy({base.getParam(n): values[n] for n in grid if n in values})
        tables.append(table.withColumn("stage", F.lit(i)))
    return base, reduce(DataFrame.unionByName, tables)


def summarize_settings(scores: DataFrame, setting: str, score_col: str) -> DataFrame:
    """Mean, standard deviation and rank of every setting."""
    table = scores.groupBy(F.col(setting).alias("setting")).agg(
        F.avg(score_col).alias("mean"), F.stddev_pop(score_col).alias("std")
    )
    return rank_settings(table)


def rank_settings(table: DataFrame) -> DataFrame:
    """Add ``rank``, best mean first. One row per parameter setting, so one task will do."""
    by_mean = Window.partitionBy(F.lit(0)).orderBy(F.col("mean").desc())
    return table.withColumn("rank", F.rank().over(by_mean))


def plane(df: DataFrame, key: str, feature: str) -> DataFrame:
    """Two-dimensional view of the feature: principal components ``(key, x, y)``."""
    rows = as_vector(df, feature)
    model = PCA(k=2, inputCol="features", outputCol="_c").fit(rows)
    c = vector_to_array("_c")
    return model.transform(rows).select(key, c[0].alias("x"), c[1].alias("y"))


def linear_score(df: DataFrame, feature: str, weights: list[float], intercept: float) -> DataFrame:
    """Score with fixed weights, as plain expressions."""
    terms = F.zip_with(F.col(feature).cast("array<double>"), F.lit(weights), lambda x, w: x * w)
    margin = F.aggregate(terms, F.lit(float(intercept)), lambda a, t: a + t)
    rows = df.filter(F.col(feature).isNotNull())
    return rows.withColumn("score", 1 / (1 + F.exp(-margin)))
