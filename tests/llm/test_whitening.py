"""Whitening against exact rational sums and a library's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from sievework.llm import catalog, whitening

SF = "/root/testdata/sf0.01"


def grid(vector):
    return [math.floor(64 * float(c)) + 1_000_000 for c in vector]


def exact_covariance(xs):
    """Covariance by loops over exact fractions."""
    n, d = len(xs), len(xs[0])
    mean = [Fraction(sum(x[i] for x in xs), n) for i in range(d)]
    centred = [[x[i] - mean[i] for i in range(d)] for x in xs]
    return np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)] for i in range(d)])


def exact_rank(matrix):
    """Rank of a matrix of fractions by elimination."""
    rows, rank = [list(r) for r in matrix], 0
    for k in range(len(rows)):
        pivot = next((r for r in range(rank, len(rows)) if rows[r][k]), None)
        if pivot is not None:
            rows[rank], rows[pivot] = rows[pivot], rows[rank]
            for r in range(rank + 1, len(rows)):
                share = rows[r][k] / rows[rank][k]
                rows[r] = [a - share * b for a, b in zip(rows[r], rows[rank])]
            rank += 1
    return rank


def check(rows, got, components):
    """``rows`` are (vec_id, grid numbers), ``got`` the query's kind of rows."""
    xs = np.array([x for _, x in rows], dtype=object)
    n, s = len(xs), xs.sum(axis=0)
    deviation = {}
    for key, x in rows:
        deviation.setdefault(key, []).append(sum((n * a - b) ** 2 for a, b in zip(x, s)))
    v = exact_covariance([x for _, x in rows]) if n * len(s) < 4000 else np.cov(xs.astype(float).T, bias=True)
    e = np.linalg.eigvalsh(v)[::-1][:components]
    assert len(got) == n
    for key, dev, w in got:
        assert dev in deviation[key] and len(w) == components
    whitened = np.array([w for _, _, w in sorted(got, key=lambda g: (g[0], g[1], g[2]))])
    assert np.abs(np.cov(whitened.T, bias=True) - np.eye(components)).max() < 1e-9
    return e


@pytest.mark.parametrize("spread", [1, 1e4, 1e9])
def test_factor_and_rotations(spread):
    rng = np.random.default_rng(0)
    for n, d in ((40, 7), (5, 9), (60, 8)):
        x = rng.normal(size=(n, d)) * np.geomspace(1, spread, d)
        if d == 8:
            x[:, 3], x[:, 5] = x[:, 1], 7.0
        x = np.round(x * 1e3).astype(object)
        v = np.array([[Fraction(0)] * d] * d)
        mean = [Fraction(int(t), n) for t in x.sum(axis=0)]
        for row in x:
            c = np.array([Fraction(int(a)) - m for a, m in zip(row, mean)])
            v = v + np.outer(c, c)
        rank = exact_rank(v)
        v = np.array([[np.longdouble(int(a.numerator)) / np.longdouble(int(a.denominator)) for a in r] for r in v / n])
        g = whitening.pivoted_cholesky(v)
        assert g.shape == (d, rank) and np.abs(g @ g.T - v).max() <= 1e-16 * v.max()
        order = [int(np.flatnonzero(g[:, k])[np.argmax(np.abs(g[:, k][np.flatnonzero(g[:, k])]))]) for k in range(rank)]
        assert all(g[order[a], b] == 0 for a in range(rank) for b in range(a + 1, rank))
        e, c = whitening.jacobi(g)
        assert (np.diff(e) <= 0).all() and np.abs(c.T @ c - np.eye(rank)).max() < 1e-16 * 10
        assert np.abs(v @ c - c * e).max() <= 1e-16 * e[0] * d
        # The smallest eigenvalue keeps its digits, which a squared matrix in doubles would lose.
        assert np.abs(c.T @ v @ c / np.sqrt(np.outer(e, e)) - np.eye(rank)).max() < 1e-6


def test_query_on_all_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r.vec_id, grid(r.embedding)) for r in table]
    x = np.array([g for _, g in rows], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = catalog.op12(spark, SF).collect()
    assert len(out) == n * 32 and len({(r.vec_id, r.component) for r in out}) == n * 32
    whitened = np.zeros((n, 32))
    place = {key: k for k, (key, _) in enumerate(rows)}
    for r in out:
        k = place[r.vec_id]
        assert r.n == n and r.deviation == int(((n * x[k] - s) ** 2).sum()) and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) < 1e-12
        whitened[k, r.component - 1] = r.whitened
    want = centred @ vectors[:, :32] / np.sqrt(values[:32])
    sign = np.sign((want * whitened).sum(axis=0))
    assert np.abs(want * sign - whitened).max() < 1e-8


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(k, (rng.normal(size=3) * [1, 5, 0.2]).tolist()) for k in range(30)]
    good += [(3, good[3][1]), (None, good[4][1]), (40, [-0.0, 1e-30, -1e-30])]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [float("nan")] * 3), (54, [1.0, float("inf"), 1.0]), (55, [1.0, 2.0]), (None, None)]
    df = spark.createDataFrame([(k, v, "x", 1, [2.0]) for k, v in good + bad], "vec_id long, embedding array<double>, deviation string, n int, `a.b` array<double>")
    df = df.repartition(4)
    model = whitening.fit(df)
    got = [(r.vec_id if r.vec_id is not None else -1, r.deviation, r.whitened) for r in whitening.whiten(df, model).collect()]
    rows = [(k if k is not None else -1, grid(v)) for k, v in good]
    e = check(rows, got, 3)
    assert np.allclose(model.eigenvalues, e, rtol=1e-12) and whitening.identity_error(df, model) < 1e-12
    assert whitening.fit(df.filter("vec_id in (51, 52, 53)")) is None
    assert whitening.whiten(df, None).count() == 0 and whitening.fit(df.limit(0)) is None
    assert whitening.fit(df, "a.b").n == len(good) + len(bad)


def test_few_and_equal_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id long, embedding array<float>")
    model = whitening.fit(one)
    assert model.n == 5 and len(model.eigenvalues) == 0
    assert [(r.deviation, r.whitened) for r in whitening.whiten(one, model).collect()] == [(0, [])] * 5
    assert whitening.identity_error(one, model) == 0


def test_numbers_beyond_a_long(spark):
    rows = [(k, [float(k) * 1e9, float(k * k), 1e300 if k == 7 else 1.0]) for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    assert model.n == 12 and len(model.eigenvalues) == 3
    out = {r.vec_id: r.deviation for r in whitening.whiten(df, model).collect()}
    assert len(out) == 12 and out[7] is None
