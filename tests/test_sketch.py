"""Frequent directions against the exact matrix."""

import numpy as np
import pytest

from sievework.operators import sketch as sk


def bits_of(spark, n=900, width=2048, parts=6):
    rng = np.random.default_rng(0)
    topics = [rng.choice(width, 60, replace=False) for _ in range(12)]
    rows = [(k, sorted({*rng.choice(topics[k % 12], 30).tolist(), *rng.integers(0, width, 6).tolist()})) for k in range(n)]
    return rows, spark.createDataFrame(rows + [(n, None), (n + 1, [])], "id long, fp array<int>").repartition(parts)


def dense(rows, width):
    out = np.zeros((len(rows), width))
    for k, (_, fp) in enumerate(rows):
        out[k, fp] = 1
    return out


@pytest.mark.parametrize("size", [16, 64])
def test_error_within_the_bound(spark, monkeypatch, size):
    monkeypatch.setattr(sk, "FAN_IN", 2)
    rows, df = bits_of(spark)
    a = dense(rows, 2048)
    found = sk.sketch(df, "fp", 2048, size).collect()
    b = np.array([r.row for r in found])
    lost = sum(r.lost for r in found)
    assert len(b) <= size and lost <= (a * a).sum() / size
    # Along every direction the sketch is shorter, by no more than what was taken off.
    gap = np.linalg.eigvalsh(a.T @ a - b.T @ b)
    assert gap.min() > -1e-6 * (a * a).sum() and gap.max() <= lost * (1 + 1e-9)


def test_compression_keeps_nulls_and_the_best_directions(spark):
    rows, df = bits_of(spark)
    model = sk.fit(df, "fp", 2048, columns=12, rows=64)
    out = {r.id: r.fpcompressed for r in sk.compress(df, "fp", model).collect()}
    assert out[900] is None and out[901] == [0.0] * 12 and len(out) == 902
    a = dense(rows, 2048)
    got = np.array([out[k] for k, _ in rows])
    assert np.allclose(got, a @ model.directions)
    # What the exact best directions leave out, and what these do.
    exact = (np.linalg.svd(a, compute_uv=False)[12:] ** 2).sum()
    assert (a * a).sum() - (got * got).sum() <= exact + 12 * model.lost


def test_a_million_positions(spark):
    width = 1 << 20
    rows, df = bits_of(spark, n=300, width=width, parts=3)
    model = sk.fit(df, "fp", width, columns=256)
    assert model.directions.shape == (sk.WIDTH, 256)
    out = {r.id: r.fpcompressed for r in sk.compress(df, "fp", model).collect()}
    got = np.array([out[k] for k, _ in rows])
    same = np.array([[len(set(x) & set(y)) for _, y in rows[:60]] for _, x in rows[:60]])
    near = got[:60] @ got[:60].T
    assert np.corrcoef(same.ravel(), near.ravel())[0, 1] > 0.98


def test_no_vectors(spark):
    _, df = bits_of(spark)
    none = df.filter("fp is null")
    model = sk.fit(none, "fp", 2048, columns=4)
    assert model.lost == 0 and sk.compress(none, "fp", model).collect()[0].fpcompressed is None
