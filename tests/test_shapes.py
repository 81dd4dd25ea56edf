"""Properties of physical plans that matter on large tables."""

from pyspark.sql import functions as F

from sievework.functions import features as ft
from sievework.operators import splits
from sievework.plans.training import linear_score

SF_DIR = "/root/testdata/sf0.001"


def main_plan(df):
    """Node names of the plan without its scalar subqueries, which work on histograms."""
    names = []

    def walk(node):
        names.append(node.nodeName())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.inputPlan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return " ".join(names)


def test_splits_do_not_move_rows(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").select("o_orderkey", "o_custkey")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    for df in (
        splits.random_split(orders, "o_orderkey", 0.2),
        splits.k_fold(orders, "o_orderkey", 5),
        splits.stratified_split(labels, "doc_id", "quality", 0.2),
        splits.stratified_k_fold(labels, "doc_id", "toxic", 5),
        splits.down_sample(labels, "doc_id", "quality", 2.0),
        splits.weight_split(orders, "o_orderkey", "o_custkey", (0.8, 0.0, 0.2)),
    ):
        plan = main_plan(df)
        assert "Scan parquet" in plan
        assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_row_features_stay_in_the_jvm(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    for df in (
        docs.select("doc_id", ft.text_fingerprint(F.col("text"))),
        docs.select(ft.exact_weight(F.col("text"))),
        linear_score(vectors, "embedding", [0.1] * 64, 0.0),
    ):
        plan = main_plan(df)
        assert "Python" not in plan and "Exchange" not in plan


def test_scans_read_only_what_is_needed(spark):
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    split = splits.balanced_group_split(lines, "l_partkey", "l_orderkey").groupBy("split").count()
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
