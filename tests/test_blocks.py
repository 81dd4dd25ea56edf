"""Training rows in blocks, and positions read from few digits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import features as ft
from sievework.functions.hashing import multiset_digest, stable_hash
from sievework.plans import network as net


def blocks_of(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"row bigint, x array<{kind}>, y array<double>, w double, parts array<int>").coalesce(1)
    return df.mapInArrow(net._blocks, net.BLOCKS).toArrow().to_batches()


def test_blocks_give_the_rows_back(spark):
    rng = np.random.default_rng(1)
    nan = float("nan")
    for draw in (lambda: rng.normal(size=5), lambda: rng.integers(0, 2, 5).astype(float)):
        rows = [(k, draw().tolist(), [nan if k % 3 else 1.0, float(k)], k / 7, [k % 3, 1]) for k in range(50)]
        got = [net._block(b, i, 5) for b in blocks_of(spark, rows) for i in range(b.num_rows)]
        row, x, y, w, parts = (np.concatenate(c) for c in zip(*got))
        assert row.tolist() == list(range(50)) and x.tolist() == [r[1] for r in rows] and w.tolist() == [r[3] for r in rows]
        assert np.array_equal(y, [r[2] for r in rows], equal_nan=True) and parts.tolist() == [r[4] for r in rows]


def test_bits_are_kept_as_bits(spark):
    rows = [(k, [float((k + j) % 2) for j in range(256)], [1.0], 1.0, [1]) for k in range(100)]
    (batch,) = blocks_of(spark, rows)
    assert len(batch.column("x")[0].as_py()) == 100 * 256 // 8


def test_unlike_lengths_end_a_fit(spark):
    rows = [(0, [1.0, 0.0], [1.0], 1.0, [1]), (1, [1.0], [0.0], 1.0, [1])]
    with pytest.raises(Exception, match="features of 1 to 2 entries"):
        blocks_of(spark, rows)


@pytest.mark.parametrize("n_bits", [8, 16, 128, 256, 100, 2048])
def test_positions_from_few_digits(spark, n_bits):
    words = [f"w{i}" for i in range(300)] + ["w1", "w2"]
    df = spark.createDataFrame([(words,), ([],), (None,)], "f array<string>")
    got = [r.b for r in df.select(ft.fold_all(F.col("f"), n_bits).alias("b")).collect()]
    long = df.filter("size(f) > 0").select(F.explode("f").alias("f")).select(F.pmod(stable_hash(F.col("f")), F.lit(n_bits)).alias("b"))
    assert got == [sorted({r.b for r in long.collect()}), [], None]


def test_single_words_are_not_joined_again(spark):
    df = spark.createDataFrame([("A b a",), ("12",), (None,)], "t string").select(ft.shingles(F.col("t"), 1).alias("s"))
    assert [r.s for r in df.collect()] == [["a", "b", "a"], [], None]
    assert "concat_ws" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_digest_reads_two_words_at_once(spark):
    keys = [f"k{i}" for i in range(200)] + ["k1", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    texts = [F.sum(stable_hash(F.col("k"), start)).cast("string") for start in (1, 9, 17, 25)]
    single = F.md5(F.concat_ws("|", F.count("k").cast("string"), *texts))
    row = df.agg(multiset_digest(F.col("k")).alias("now"), single.alias("single")).first()
    assert row.now == row.single
    plan = df.agg(multiset_digest(F.col("k")))._jdf.queryExecution().optimizedPlan().toString()
    assert "16, -10" in plan and "16, 10" not in plan
