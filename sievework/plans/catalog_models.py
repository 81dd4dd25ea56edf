"""Queries that train and score models. Learned weights have no SQL twin, so most of these
have no SQL; fixed weights and means over given scores do."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from sievework.functions.features import text_fingerprint, to_dense
from sievework.operators import metrics, neighbours
from sievework.operators.reduce import as_vector
from sievework.operators.splits import class_weights, k_fold, stratified_split
from sievework.plans import network, training
from sievework.plans.catalog_sources import LINEAR, WEIGHTS
from sievework.plans.registry import query, table, texts
from sievework.session import materialize


def one_vs_rest(spark, d, targets=(0, 1)):
    """Embeddings with one 0/1 column per wanted label."""
    df = table(spark, d, "embeddings")
    return df.select(
        "vec_id", "embedding", "label", *[(F.col("label") == t).cast("int").alias(f"is_{t}") for t in targets]
    )


def rounded(df, keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in df.columns if c not in keys])


@query("m1_single_target_models")
def m1(spark, d):
    scored, _ = training.train_single(
        one_vs_rest(spark, d), "vec_id", "embedding", ["is_0", "is_1"],
        lambda: training.logistic(20, 0.01), "random", folds=2,
    )
    return rounded(metrics.evaluation(scored), ["target", "fold"])


@query("m1_network_with_sampling")
def m1_network(spark, d):
    scored, _ = training.train_single(
        one_vs_rest(spark, d, (0,)), "vec_id", "embedding", ["is_0"],
        lambda: training.network(training.halving_layers(64), 30), "random", folds=1, fraction=0.5,
    )
    return rounded(metrics.evaluation(scored), ["target", "fold"])


@query("m1_group_folds")
def m1_groups(spark, d):
    df = one_vs_rest(spark, d, (0,)).withColumn("grp", F.expr("vec_id div 5"))
    scored, _ = training.train_single(
        df, "vec_id", "embedding", ["is_0"], lambda: training.logistic(20, 0.01), "group", folds=2, group="grp",
    )
    return rounded(metrics.evaluation(scored), ["target", "fold"])


@query("m1_weight_order")
def m1_weight(spark, d):
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    df = one_vs_rest(spark, d, (0,)).withColumn("w", norm)
    scored, _ = training.train_single(
        df, "vec_id", "embedding", ["is_0"], lambda: training.logistic(20, 0.01), "weight", folds=1, weight="w",
    )
    return rounded(metrics.evaluation(scored), ["target", "fold"])


@query("m1_text_fingerprints")
def m1_text(spark, d):
    """2,048 text bits per document, both document targets, two folds."""
    labels = table(spark, d, "labels")
    df = texts(spark, d).select("doc_id", "text").join(labels, "doc_id")
    # Features are computed once, of labelled texts only, and kept.
    fp = text_fingerprint(F.col("text"), 2, 2048).alias("fp")
    words = materialize(df.select("doc_id", fp, *[c for c in labels.columns if c != "doc_id"]), "features")
    # Set bits to a sparse vector, in the JVM.
    terms = [str(i) for i in range(2048)]
    encoder = CountVectorizerModel.from_vocabulary(terms, inputCol="bits", outputCol="features")
    # A text without words has no feature, and the encoder takes no null.
    words = words.filter(F.col("fp").isNotNull())
    vectors = encoder.transform(words.withColumn("bits", F.col("fp").cast("array<string>")))
    scored, _ = training.train_single(
        vectors, "doc_id", "features", ["quality", "toxic"], lambda: training.logistic(11, 0.01), "random", folds=2,
    )
    return rounded(metrics.evaluation(scored), ["target", "fold"])


@query("m2_shallow_network")
def m2(spark, d):
    df = as_vector(one_vs_rest(spark, d, (0,)), "embedding").withColumn("label", F.col("is_0").cast("double"))
    parts = materialize(stratified_split(df, "vec_id", "label", 0.3), "parts")
    model = training.network(training.shallow_layers(64), 15).fit(parts.filter("split = 'train'"))
    return training.score(parts.filter("split = 'test'"), model).select("vec_id", F.round("score", 6).alias("score"))


@query("m2_network_with_dropout")
def m2_dropout(spark, d):
    """Both targets' shallow networks with dropout, decay and penalty, trained in the same jobs."""
    df = materialize(labelled_texts(spark, d), "texts")
    settings = network.Settings(hidden=tuple(training.SHALLOW), rate=0.01, decay=0.01, l2=0.0001, dropout=0.1, rounds=20, activation="selu")
    rows, runs = network.fold_runs(k_fold(df, "doc_id", 2), "fold", 1, "doc_id", settings)
    scored = network.score(rows, "doc_id", "x", network.fit(rows, "doc_id", "x", ["quality", "toxic"], runs))
    scored = scored.filter("y_true is not null").select("id", "target", F.lit(1).alias("fold"), "y_true", "score")
    return rounded(metrics.evaluation(materialize(scored, "scored")), ["target", "fold"])


@query("m3_multi_target_models")
def m3(spark, d):
    table_, _, _ = training.train_multi(
        one_vs_rest(spark, d), "vec_id", "embedding", ["is_0", "is_1"], lambda: training.logistic(20, 0.01), folds=2
    )
    return rounded(table_, ["fold"])


def labelled_texts(spark, d, n_bits=256):
    """Labelled documents with bits of their words, as numbers; a third of the labels of each
    target are taken away, so many rows have one of the two."""
    bits = to_dense(text_fingerprint(F.col("text"), 1, n_bits), n_bits)
    docs = texts(spark, d).join(table(spark, d, "labels"), "doc_id").withColumn("x", bits.cast("array<double>"))
    there = lambda t: F.crc32(F.concat_ws(":", F.lit(t), "doc_id").cast("binary")) % 3 > 0
    return docs.select("doc_id", "x", *[F.when(there(t), F.col(t)).alias(t) for t in ("quality", "toxic")])


@query("m3_shared_network")
def m3_shared(spark, d):
    """One network for both targets, rows with one label included, next to a model per target."""
    targets, folds = ["quality", "toxic"], 2
    placed = materialize(k_fold(materialize(labelled_texts(spark, d), "texts"), "doc_id", folds), "folds")
    settings = network.Settings(hidden=(32,), rounds=30, rate=0.03, l2=0.0005, dropout=0.1, patience=8)
    rows, runs = network.fold_runs(placed, "fold", folds, "doc_id", settings)
    fitted = network.fit(rows, "doc_id", "x", targets, runs)
    scored = network.score(rows, "doc_id", "x", fitted).filter("y_true is not null")
    scored = scored.withColumn("fold", F.regexp_extract("run", r"(\d+)$", 1).cast("int"))
    shared = materialize(scored.select("id", "target", "fold", "y_true", "score"), "shared")
    separate = materialize(training.separate_models(placed, "doc_id", "x", targets, folds, lambda: training.logistic(20, 0.01)), "separate")
    name = lambda df, to: metrics.weighted_f1(df, ["fold"]).select("fold", F.round("f1", 6).alias(to))
    one = F.count_if(F.col("quality").isNull() != F.col("toxic").isNull()).alias("rows_with_one_label")
    known = placed.groupBy("fold").agg(one)
    return known.join(name(shared, "f1_shared"), "fold").join(name(separate, "f1_separate"), "fold")


@query("m5_early_stopping")
def m5_stops(spark, d):
    """Rounds of a flat and a deep run on weighted rows, where each stopped and which was restored."""
    df = class_weights(materialize(labelled_texts(spark, d), "texts"), "quality")
    parts = stratified_split(df, "doc_id", "quality", 0.3).withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    parts = parts.withColumnRenamed("split", "flat").withColumn("deep", F.col("flat"))
    runs = {
        "flat": network.Settings(hidden=(), rounds=25, rate=0.01, patience=4, min_delta=0.001),
        "deep": network.Settings(hidden=network.halving(256), rounds=25, rate=0.002, patience=4, min_delta=0.001, activation="selu"),
    }
    fitted = network.fit(parts, "doc_id", "x", ["quality"], runs, weight="weight")
    return rounded(fitted.history.join(fitted.stops, "run"), ["run", "epoch", "best_epoch", "stop_epoch"])


@query("m6_successive_halving")
def m6_halving(spark, d):
    """Six settings on shared folds, half of them dropped after each of three rungs."""
    placed = materialize(k_fold(materialize(labelled_texts(spark, d, 128), "texts"), "doc_id", 2), "folds")
    settings = {
        f"{a}-{r}-{h}": network.Settings(hidden=(h,), activation=a, rate=r)
        for a, r, h in (("relu", 0.01, 16), ("relu", 0.05, 16), ("tanh", 0.01, 16), ("tanh", 0.05, 32), ("selu", 0.01, 32), ("selu", 0.05, 8))
    }
    scores = network.successive_halving(placed, "doc_id", "x", ["quality", "toxic"], settings, "fold", 2, (3, 6, 12))
    return network.halving_ranks(scores).withColumn("mean", F.round("mean", 6))


@query("m4_score_fixed_weights", f"select vec_id, round(score, 6) as score from {LINEAR}")
def m4(spark, d):
    scored = training.linear_score(table(spark, d, "embeddings"), "embedding", WEIGHTS, 0.1)
    return scored.select("vec_id", F.round("score", 6).alias("score"))


@query("m4_score_trained_model")
def m4_trained(spark, d):
    df = as_vector(one_vs_rest(spark, d, (0,)), "embedding").withColumn("label", F.col("is_0").cast("double"))
    parts = materialize(stratified_split(df, "vec_id", "label", 0.3), "parts")
    model = training.logistic(20, 0.01).fit(parts.filter("split = 'train'"))
    return training.score(parts.filter("split = 'test'"), model).select("vec_id", F.round("score", 6).alias("score"))


@query("m5_fit_and_evaluate")
def m5(spark, d):
    df = as_vector(one_vs_rest(spark, d, (0,)), "embedding").withColumn("label", F.col("is_0").cast("double"))
    parts = materialize(stratified_split(df, "vec_id", "label", 0.3), "parts")
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    _, report = training.fit_and_evaluate(train, test, "vec_id", lambda: training.logistic(20, 0.01), "is_0")
    return rounded(report, ["target", "fold"])


@query("m6_grid_search")
def m6(spark, d):
    df = as_vector(one_vs_rest(spark, d, (0,)), "embedding").withColumn("label", F.col("is_0").cast("double"))
    grid = {"regParam": [0.001, 0.1], "maxIter": [5, 15]}
    _, settings = training.grid_search(df.select("vec_id", "features", "label"), training.logistic(), grid, "vec_id", folds=2)
    return settings.select("setting", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "rank")


@query("m7_stage_wise_tuning")
def m7(spark, d):
    df = as_vector(one_vs_rest(spark, d, (0,)), "embedding").withColumn("label", F.col("is_0").cast("double"))
    stages = [{"maxIter": [5, 15]}, {"regParam": [0.001, 0.1]}]
    _, settings = training.tune_in_stages(df.select("vec_id", "features", "label"), training.logistic(), stages, "vec_id", folds=2)
    return settings.select("stage", "setting", F.round("mean", 6).alias("mean"), "rank")


@query("m8_two_dimensional_view")
def m8(spark, d):
    return training.plane(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("m8_neighbour_graph")
def m8_graph(spark, d):
    """Each vector's ten nearest others, found by improving a graph."""
    found = neighbours.neighbour_graph(table(spark, d, "embeddings"), "vec_id", "embedding", 10)
    return found.withColumn("distance", F.round("distance", 6))


@query("m8_neighbour_view")
def m8_view(spark, d):
    """Two coordinates from the graph of neighbours."""
    return neighbours.graph_view(table(spark, d, "embeddings"), "vec_id", "embedding", 10)


@query(
    "m9_ensemble_score",
    f"select vec_id, round(avg(score), 6) as score from (select vec_id, score from {LINEAR} union all "
    f"select vec_id, 1 / (1 + exp(-label::DOUBLE / 10)) from embeddings) group by vec_id",
)
def m9(spark, d):
    df = table(spark, d, "embeddings")
    first = training.linear_score(df, "embedding", WEIGHTS, 0.1).select("vec_id", "score")
    second = df.select("vec_id", (1 / (1 + F.exp(-F.col("label") / 10))).alias("score"))
    return rounded(metrics.mean_score([first, second], ["vec_id"]), ["vec_id"])
