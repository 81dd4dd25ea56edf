"""Whitening of vectors: principal components of unit variance.

Vectors become whole numbers, so the scatter around a whole-number centre is summed without any
rounding: every task adds up its own vectors, and sums of one entry of the matrix meet by key.
What reaches the driver has the size of one vector squared, whatever the number of vectors.

There the centred scatter is factored by Cholesky's method with pivots, and the triangular factor
is turned by one-sided Jacobi rotations until its columns are orthogonal: their squared norms are
the eigenvalues and the normalised columns the components. The squares of small singular values
are never formed, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the grid in one unit, and what is added to a grid number.
SCALE, SHIFT = 64, 1_000_000
#: Grid numbers saturate here, at components of some 4e12.
LARGEST = 1 << 48
#: Whole numbers up to here are exact in doubles.
EXACT = 1 << 53
#: What is left of an entry's variance below this share of it, per dimension, is rounding.
NOISE = 2.0**-60
WHITENED = "vec_id long, deviation long, whitened array<double>"


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, grid numbers as a matrix) of the usable vectors of a batch, for each length.

    Null and empty vectors, and those with a null or non-finite entry, are left out.
    """
    rows = np.flatnonzero(~np.asarray(column.is_null()))
    if not len(rows):
        return
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().drop_null().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    usable = sizes > 0
    usable[np.repeat(np.arange(len(rows)), sizes)[~np.isfinite(values)]] = False
    for size in np.unique(sizes[usable]):
        chosen = np.flatnonzero(usable & (sizes == size))
        matrix = values[starts[chosen][:, None] + np.arange(size)]
        with np.errstate(over="ignore"):
            grid = np.clip(np.floor(SCALE * matrix), -LARGEST, LARGEST).astype(np.int64)
        yield rows[chosen], grid + SHIFT


def _products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of whole numbers as Python's integers, so without rounding or overflow."""
    bound = max(int(np.abs(y).max(initial=0)), 1) ** 2
    if bound > EXACT:
        y = y.astype(object)
        return y.T @ y
    total = np.zeros((y.shape[1],) * 2, dtype=object)
    rows = max(EXACT // bound, 1)
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64)
    return total


def _sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for rows, x in _vectors(batch.column(0)):
            n, total = found.get(x.shape[1], (0, 0))
            # 2 ** 13 numbers of at most 2 ** 49 fit a long; longer sums are Python's integers.
            for at in range(0, len(x), 1 << 13):
                total = total + x[at : at + (1 << 13)].sum(axis=0).astype(object)
            found[x.shape[1]] = (n + len(rows), total)
    for width, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()),
             pa.array([Decimal(int(v)) for v in total], pa.decimal128(38))],
            names=["width", "i", "n", "total"],
        )


def _scatter_of(centre: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, total = len(centre), None
        for batch in batches:
            for _, x in _vectors(batch.column(0)):
                if x.shape[1] == width:
                    part = _products(x - centre)
                    total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38))],
                names=["i", "j", "total"],
            )

    return run


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """``g`` with ``g @ g.T == matrix`` and a column for each pivot that is no rounding.

    With its rows in the order of the pivots ``g`` is lower triangular.
    """
    rest = matrix.copy()
    least = NOISE * len(rest) * rest.diagonal()
    left, columns = np.ones(len(rest), dtype=bool), []
    while (open_ := left & (rest.diagonal() > least)).any():
        pivot = int(np.argmax(np.where(open_, rest.diagonal(), -1)))
        column = np.where(left, rest[:, pivot], 0) / np.sqrt(rest[pivot, pivot])
        rest = rest - np.outer(column, column)
        left[pivot] = False
        columns.append(column)
    return np.array(columns, dtype=matrix.dtype).T.reshape(len(rest), len(columns))


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``n`` columns in rounds whose pairs are disjoint."""
    ring = [*range(n)] + [-1] * (n % 2)
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[:half - 1:-1]) if min(a, b) >= 0]
        if pairs:
            p, q = zip(*pairs)
            yield np.array(p), np.array(q)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of ``factor @ factor.T``.

    Columns are turned in pairs until all are orthogonal to the last digit.
    """
    g = factor.copy()
    small = np.finfo(g.dtype).eps * np.sqrt(len(g))
    for _ in range(sweeps):
        turned = False
        for p, q in _rounds(g.shape[1]):
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            turn = np.abs(ab) > small * np.sqrt(aa) * np.sqrt(bb)
            if not turn.any():
                continue
            turned = True
            zeta = (bb - aa) / (2 * np.where(turn, ab, 1))
            t = np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn, t, 0)
            c = 1 / np.sqrt(1 + t * t)
            g[:, p], g[:, q] = c * a - c * t * b, c * t * a + c * b
        if not turned:
            break
    norms = np.sqrt((g * g).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, g[:, order] / norms[order]


@dataclass(frozen=True)
class Whitening:
    """What ``whiten`` needs: all of it has the size of a vector, or of one squared.

    ``n`` vectors had the sums ``centre * n + rest``; ``components`` holds unit eigenvectors as
    columns, with their ``eigenvalues`` and the share of the whole variance that each explains.
    """

    column: str
    n: int
    centre: np.ndarray
    rest: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Vectors without the mean, rounded once."""
        return (x - self.centre) - np.array([float(Fraction(r, self.n)) for r in self.rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of ``n * x - S``, exact; null beyond a long."""
        y, rest = x - self.centre, self.rest
        far = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
        if far * far * len(rest) < 1 << 63:
            d = self.n * y - np.array(rest, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * y.astype(object) - np.array(rest, dtype=object)
        return [v if v < 1 << 63 else None for v in map(int, (d * d).sum(axis=1))]


def fit(vectors: DataFrame, column: str = "embedding", components: int = 32) -> Whitening | None:
    """Components of all usable vectors of ``column``; null where there is none.

    Usable are vectors without null or non-finite entries, of the length that most of them have
    (of equally frequent lengths the longest). An entry ``c`` is the whole number
    ``floor(64 * c) + 1000000``. Up to ``components`` components of positive variance are kept.
    """
    only = vectors.select(F.col(f"`{column}`").alias("v"))
    sums = only.mapInArrow(_sums_of, "width int, i int, n long, total decimal(38,0)")
    sums = sums.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
    first = sums.withColumn("rank", F.rank().over(Window.orderBy(F.desc("n"), F.desc("width")))).filter("rank = 1")
    sums = {r.i: r for r in first.collect()}
    if not sums:
        return None
    n, totals = sums[0].n, [int(sums[i].total) for i in range(len(sums))]
    centre = np.array([round(Fraction(t, n)) for t in totals], dtype=np.int64)
    rest = [t - n * int(c) for t, c in zip(totals, centre)]

    parts = only.mapInArrow(_scatter_of(centre), "i int, j int, total decimal(38,0)")
    covariance = np.zeros((len(totals),) * 2, dtype=np.longdouble)
    for r in parts.groupBy("i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect():
        exact = n * int(r.total) - rest[r.i] * rest[r.j]
        covariance[r.i, r.j] = covariance[r.j, r.i] = np.longdouble(exact) / np.longdouble(n) / np.longdouble(n)

    values, directions = jacobi(pivoted_cholesky(covariance))
    values, directions = values[:components], directions[:, :components]
    explained = (values / covariance.trace()).astype(np.float64) if len(values) else np.zeros(0)
    return Whitening(column, n, centre, rest, values.astype(np.float64), directions.astype(np.float64), explained)


def _whitener(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch.column(1)):
                if x.shape[1] == len(model.centre):
                    out = model.project(x)
                    offsets = np.arange(len(rows) + 1, dtype=np.int32) * out.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(model.deviations(x), pa.int64()), lists],
                        names=["vec_id", "deviation", "whitened"],
                    )

    return run


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """``(vec_id, deviation, whitened)`` of every usable vector; others have no row.

    ``vectors`` needs ``vec_id`` and the model's column; other columns are ignored, repeated
    vectors and ids, null ones too, keep a row each. ``deviation`` is the exact sum of squares of
    ``n * x - S``, null beyond a long. Without a model, and so without vectors, there is no row.
    """
    if model is None:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{model.column}`").alias("v"))
    return named.mapInArrow(_whitener(model), WHITENED)


def _moments(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.eigenvalues)
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for _, x in _vectors(batch.column(0)):
                if x.shape[1] == len(model.centre):
                    w = np.hstack([model.project(x), np.ones((len(x), 1))])
                    total += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "total"])

    return run


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(model.eigenvalues)
    only = vectors.select(F.col(f"`{model.column}`").alias("v"))
    sums = only.mapInArrow(_moments(model), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    total = np.zeros((k + 1, k + 1))
    for r in sums.collect():
        total[r.i, r.j] = total[r.j, r.i] = r.total
    mean = total[:k, k] / model.n
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))
