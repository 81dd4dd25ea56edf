import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import features as ft
from sievework.operators import frame
from sievework.plans import training
from sievework.plans.catalog import QUERIES
from sievework.session import shared_dir, shared_path
from sievework.sources import files
from sievework.streaming.rows import read_stream, run_available


def test_layers():
    assert training.halving_layers(2048) == [2048, 1024, 512, 256, 128, 2]
    assert training.shallow_layers(10) == [10] + [50] * 8 + [2]


def test_folds_of_each_kind(spark):
    df = spark.range(60).select(
        "id", (F.col("id") % 3 == 0).cast("int").alias("y"), F.expr("id div 6").alias("g"),
        F.col("id").cast("double").alias("w"),
    )
    for kind, folds in (("random", 3), ("random", 1), ("group", 2), ("group", 1), ("weight", 1)):
        placed, numbers = training.target_folds(df, "id", "y", kind, folds, 0.2, 42, "g", "w")
        assert placed.count() == 60 and len(numbers) == folds
        for f in numbers:
            tags = {r[0] for r in placed.select(f"split_{f}").distinct().collect()}
            assert {"train", "test"} <= tags <= {"train", "val", "test"}
    with pytest.raises(ValueError):
        training.target_folds(df, "id", "y", "weight", 2, 0.2, 42, "g", "w")
    with pytest.raises(ValueError):
        training.target_folds(df, "id", "y", "other", 1, 0.2, 42)


def test_row_operators_run_on_a_stream(spark):
    source, target, state = (shared_path(spark, n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([(1, "one two three four", "yes"), (2, None, "no")], "id bigint, t string, f string")
    rows.write.parquet(source)
    operator = lambda df: df.select(
        "id", ft.text_fingerprint(F.col("t")).alias("fp"), frame.to_boolean(F.col("f")).alias("flag")
    )
    stream = read_stream(spark, source, rows.schema)
    run_available(stream, operator, target, state).awaitTermination(120)
    key = lambda r: r["id"]
    assert sorted(spark.read.parquet(target).collect(), key=key) == sorted(operator(rows).collect(), key=key)


def test_boolean_text(spark):
    words = spark.createDataFrame([("Yes",), ("F",), ("maybe",), (None,)], "t string")
    got = [r[0] for r in words.select(frame.to_boolean(F.col("t"))).collect()]
    assert got == [True, False, None, None]
    with pytest.raises(Exception, match="not a boolean"):
        words.select(frame.to_boolean(F.col("t"), strict=True)).collect()


def test_target_discovery(spark):
    df = spark.createDataFrame([(1, "C", 1, 0)], "id int, smiles string, AR int, Other int")
    assert frame.target_columns(df) == ["AR", "Other"]
    assert frame.target_columns(df, known=frame.KNOWN_TARGETS) == ["AR"]


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        files.load_any(spark, "table.xml")


def test_convert_nothing(spark):
    path = shared_path(spark, "none")
    spark.range(1).write.csv(f"{path}/a.csv")
    assert files.convert_all(spark, path, {}, lambda df: df).count() == 0


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")


def test_fingerprints_of_labelled_texts_only(spark, monkeypatch, tmp_path):
    """Texts without label are left out before their words are hashed."""
    from sievework.plans import catalog_models

    class Seen(Exception):
        pass

    def stop(df, name):
        raise Seen(df)

    spark.createDataFrame([(i, f"word {i}") for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(catalog_models, "materialize", stop)
    with pytest.raises(Seen) as seen:
        catalog_models.m1_text(spark, str(tmp_path))
    df = seen.value.args[0]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("md5(") < plan.index("Join ")
    assert sorted(r.doc_id for r in df.collect()) == [1, 2]
    assert df.columns == ["doc_id", "fp", "quality", "toxic"]


def test_text_models_leave_out_texts_without_words(spark, tmp_path):
    """Labelled texts that are null or hold no word are in no fold; the others score as without them."""
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["good", "fine", "bad", "poor", "word", "text"], k=8)), k % 2, k // 2 % 2) for k in range(120)]
    odd = [(200, None, 1, 0), (201, "4935 1174 .", 0, 1), (202, "", 1, 1)]
    got = []
    for name, more in (("plain", []), ("odd", odd)):
        spark.createDataFrame([r[:2] for r in rows + more], "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels = [(k, q, t) for k, _, q, t in rows + more]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = QUERIES["m1_text_fingerprints"](spark, f"{tmp_path}/{name}")
        got.append(sorted((r["target"], r["fold"], r["accuracy"], r["loss"]) for r in out.collect()))
    assert len(got[0]) == 4 and got[0] == got[1]
