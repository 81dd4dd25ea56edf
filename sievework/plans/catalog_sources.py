"""Queries that go through files: every one writes tables to the shared folder and reads
them back."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sievework.functions import features as ft
from sievework.functions.hashing import stable_hash
from sievework.operators import metrics
from sievework.operators.reduce import as_vector
from sievework.plans import training
from sievework.plans.catalog_features import text_bits_sql
from sievework.plans.catalog_frame import CLASS_SCORES
from sievework.plans.registry import hash32, query, scored_labels, table, texts
from sievework.session import shared_path
from sievework.sources import files, versions


@query("s1_csv_with_header", "select * from part")
def s1(spark, d):
    part, path = table(spark, d, "part"), shared_path(spark, "part") + ".csv"
    part.write.option("header", True).csv(path)
    return files.read_csv(spark, path, part.schema)


@query("s2_tsv_without_header", "select n_nationkey, n_name, n_regionkey from nation")
def s2(spark, d):
    path = shared_path(spark, "nation") + ".tsv"
    table(spark, d, "nation").write.option("sep", "\t").csv(path)
    schema = StructType(
        [
            StructField("n_nationkey", IntegerType()),
            StructField("n_name", StringType()),
            StructField("n_regionkey", IntegerType()),
        ]
    )
    return files.read_inchi_tsv(spark, path, schema)


@query(
    "s3_load_with_reader",
    f"""select d.doc_id, b.n as bits from documents d left join
        (select doc_id, count(*) as n from {text_bits_sql(1024, 2)} group by doc_id) b on b.doc_id = d.doc_id""",
)
def s3(spark, d):
    def add_features(df):
        return df.withColumn("fp", ft.text_fingerprint(F.col("text"), 2, 1024))

    loaded = files.load(
        spark, d, lambda session, folder: texts(session, folder), add_features
    )
    bits = F.when(F.col("fp").isNotNull(), F.size("fp")).cast("bigint")
    return loaded.select("doc_id", bits.alias("bits"))


@query(
    "s4_feature_snapshot",
    """select vec_id, label, list_count(list_filter(embedding, lambda v: v > 0))::INTEGER as ones from embeddings""",
)
def s4(spark, d):
    path = shared_path(spark, "features") + ".parquet"
    df = table(spark, d, "embeddings").select("vec_id", "label", ft.sign_bits(F.col("embedding")).alias("fp"))
    files.save_features(df, path, partition_by=["label"])
    return files.load(spark, path).select("vec_id", "label", F.size("fp").alias("ones"))


@query(
    "s4_refreshed_features",
    f"""select vec_id, label, list_count(list_filter(embedding, lambda v: v > 0))::INTEGER as ones,
          (case when {hash32('vec_id::varchar')} % 100 < 2 then 2 else 1 end)::BIGINT as version from embeddings""",
)
def s4_refreshed(spark, d):
    """A snapshot of a table in which one row in a hundred had another label and one was missing,
    brought up to date: only these rows' features are computed again."""
    root = shared_path(spark, "features")
    df = table(spark, d, "embeddings")
    place = F.pmod(stable_hash(F.col("vec_id")), F.lit(100))
    before = df.filter(place != 0).withColumn("label", F.when(place == 1, F.col("label") + 1).otherwise(F.col("label")))
    signs = lambda rows: rows.withColumn("fp", ft.sign_bits(F.col("embedding")))
    for rows in (before, df):
        versions.refresh(rows, "vec_id", root, signs)
    out = versions.read_features(spark, root, "vec_id")
    return out.select("vec_id", "label", F.size("fp").alias("ones"), F.col("_version").alias("version"))


@query(
    "s5_convert_all",
    """select 'customer.csv' as file, count(*) as rows, count(*) filter (c_mktsegment not like '%U%') as null_features from customer
       union all select 'nation.tsv', count(*), count(*) filter (n_name not like '%1%') from nation""",
)
def s5(spark, d):
    directory = shared_path(spark, "convert")
    table(spark, d, "customer").write.option("header", True).csv(f"{directory}/customer.csv")
    table(spark, d, "nation").write.option("sep", "\t").csv(f"{directory}/nation.tsv")
    table(spark, d, "region").write.option("header", True).csv(f"{directory}/other.csv")
    rules = {"customer.csv": files.read_csv, "nation.tsv": files.read_inchi_tsv}

    def add_features(df):
        text, wanted = ("c_mktsegment", "U") if "c_mktsegment" in df.columns else ("inchi", "1")
        return df.withColumn(
            "fp", ft.valid_or_null(F.col(text).contains(wanted), ft.text_fingerprint(F.col(text), 1, 64))
        )

    return files.convert_all(spark, directory, rules, add_features)


@query("s6_load_any", "select r_regionkey::VARCHAR as r_regionkey, r_name from region")
def s6(spark, d):
    path = shared_path(spark, "region") + ".csv"
    table(spark, d, "region").write.option("header", True).csv(path)
    return files.load_any(spark, path).select("r_regionkey", "r_name")


@query(
    "s7_fingerprint_file",
    f"""select array_to_string(list_transform(range(64), lambda i: case when list_contains(bits, i) then '1' else '0' end), '') as fp
        from (select p_partkey, list(bit) as bits from {text_bits_sql(64, 1, 'part', 'p_partkey', 'p_name')} group by p_partkey)""",
)
def s7(spark, d):
    source, target = shared_path(spark, "names") + ".csv", shared_path(spark, "fp") + ".csv"
    table(spark, d, "part").select(F.col("p_name").alias("smiles")).write.option("header", True).option(
        "sep", ";"
    ).csv(source)
    files.fingerprint_file(
        spark, source, target, lambda df: df.withColumn("fp", ft.text_fingerprint(F.col("smiles"), 1, 64)), 64
    )
    return files.read_csv(spark, target)


WEIGHTS = [((i * 7) % 11 - 5) / 10 for i in range(64)]
LINEAR = f"""(select vec_id, label, 1 / (1 + exp(-(0.1::DOUBLE + list_sum(list_transform(
    list_zip(embedding::DOUBLE[], {WEIGHTS}::DOUBLE[]), lambda p: p[1] * p[2]))))) as score from embeddings)"""


@query("s8_prediction_sink", f"select vec_id, label, round(score, 6) as score from {LINEAR}")
def s8(spark, d):
    path = shared_path(spark, "predictions") + ".csv"
    df = table(spark, d, "embeddings").withColumnRenamed("embedding", "fp")
    files.write_predictions(training.linear_score(df, "fp", WEIGHTS, 0.1), path)
    back = files.read_csv(spark, path)
    return back.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("int").alias("label"),
        F.round(F.col("score").cast("double"), 6).alias("score"),
    )


@query(
    "s9_result_sinks",
    f"""select target, fold, round(accuracy, 6) as accuracy, tn + fp + fn + tp as predictions from {CLASS_SCORES}""",
)
def s9(spark, d):
    path, scored = shared_path(spark, "results"), scored_labels(spark, d)
    files.write_results({"predictions": scored, "evaluation": metrics.evaluation(scored)}, path)
    predictions = files.read_parquet(spark, f"{path}/predictions")
    counts = predictions.groupBy("target", "fold").agg(F.count(F.lit(1)).alias("predictions"))
    scores = files.read_parquet(spark, f"{path}/evaluation")
    return scores.select("target", "fold", F.round("accuracy", 6).alias("accuracy")).join(
        counts, ["target", "fold"]
    )


@query("s10_publish_best_model")
def s10(spark, d):
    df = as_vector(table(spark, d, "embeddings"), "embedding")
    labelled = df.withColumn("label", (F.col("label") == 0).cast("double"))
    path = shared_path(spark, "best")
    for rounds in (2, 10):
        files.publish_best(spark, training.logistic(rounds, 0.01).fit(labelled), path)
    model = LogisticRegressionModel.load(versions.latest(spark, path))
    return training.score(labelled, model).select("vec_id", F.round("score", 6).alias("score"))
