"""Compression of very wide sparse vectors by frequent directions.

A sketch of a few rows stands for all rows of a matrix: whenever its buffer is full, the squared
length of every direction is reduced by that of the middle one, which empties half of it. Sketches
are merged by sketching their rows, so partitions are summarised on their own and meet in a few
rounds. No matrix of width by width exists anywhere, and a task holds one buffer.

The squared length of the matrix along any unit vector is that of the sketch or more, by no more
than what was taken off (``lost``), which is at most the sum of all squares over ``rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import materialize

#: Columns of a sketch; positions of wider vectors are folded into as many by a signed hash, which
#: keeps inner products in expectation.
WIDTH = 1 << 13
#: Sketches that one task merges.
FAN_IN = 16
SKETCH = "row array<double>, lost double"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def folded(positions: np.ndarray, n_bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and sign of every position; vectors no wider than the sketch stay as they are."""
    if n_bits <= width:
        return positions, np.ones(len(positions))
    h = _mixed(positions)
    return (h % np.uint64(width)).astype(np.int64), 1.0 - 2.0 * (h >> np.uint64(63))


class Directions:
    """A sketch of at most ``2 * rows`` rows while it is filled and of ``rows`` when it is read."""

    def __init__(self, rows: int, width: int):
        self.rows, self.buffer, self.used, self.lost = rows, np.zeros((2 * rows, width)), 0, 0.0

    def add(self, matrix: np.ndarray) -> None:
        at = 0
        while at < len(matrix):
            if self.used == 2 * self.rows:
                self.shrink()
            n = min(len(matrix) - at, 2 * self.rows - self.used)
            self.buffer[self.used : self.used + n] = matrix[at : at + n]
            self.used, at = self.used + n, at + n

    def shrink(self) -> None:
        """Leave at most ``rows`` directions, orthogonal and the longest first."""
        part = self.buffer[: self.used]
        squares, turn = np.linalg.eigh(part @ part.T)
        order = np.argsort(-squares)
        squares, turn = np.maximum(squares[order], 0), turn[:, order]
        off = squares[self.rows] if len(squares) > self.rows else 0.0
        kept = np.maximum(squares - off, 0)[: self.rows]
        scale = np.sqrt(np.divide(kept, squares[: self.rows], out=np.zeros_like(kept), where=squares[: self.rows] > 0))
        top = scale[:, None] * (turn[:, : self.rows].T @ part)
        self.buffer[:] = 0
        self.buffer[: len(top)] = top
        self.used, self.lost = int((scale > 0).sum()), self.lost + float(off)

    def batch(self) -> pa.RecordBatch:
        if self.used > self.rows:
            self.shrink()
        n = max(self.used, 1)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.buffer.shape[1])
        lists = pa.ListArray.from_arrays(offsets, pa.array(self.buffer[:n].ravel()))
        # What the whole sketch has lost stands in its first row.
        return pa.RecordBatch.from_arrays([lists, pa.array([self.lost] + [0.0] * (n - 1))], names=["row", "lost"])


def _dense(column: pa.Array, n_bits: int, width: int) -> np.ndarray:
    """Rows of a batch of position lists."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    columns, signs = folded(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n_bits, width)
    out = np.zeros((len(column), width))
    np.add.at(out, (np.repeat(np.arange(len(column)), sizes), columns), signs)
    return out


def _sketching(rows: int, n_bits: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Directions(rows, width)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                sketch.add(_dense(batch.column(0).slice(at, rows), n_bits, width))
        if sketch.used:
            yield sketch.batch()

    return run


def _merging(rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Directions(rows, width)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                sketch.add(part.column(0).flatten().to_numpy().reshape(part.num_rows, width))
                sketch.lost += float(np.asarray(part.column(1)).sum())
        if sketch.used:
            yield sketch.batch()

    return run


def sketch(df: DataFrame, bits: str, n_bits: int, rows: int, width: int = WIDTH) -> DataFrame:
    """``(row, lost)``: at most ``rows`` rows that stand for the vectors with ones at ``bits``.

    Rows without vector are left out. Positions are in 0..n_bits-1.
    """
    width = min(width, n_bits)
    parts = df.filter(F.col(bits).isNotNull()).select(bits).mapInArrow(_sketching(rows, n_bits, width), SKETCH)
    number = df.rdd.getNumPartitions()
    # A round of merging takes FAN_IN sketches to one.
    while True:
        parts = materialize(parts, "sketch")
        number = -(-number // FAN_IN)
        parts = parts.repartition(number).mapInArrow(_merging(rows, width), SKETCH)
        if number == 1:
            return materialize(parts, "sketch")


@dataclass(frozen=True)
class Compression:
    """Unit directions (columns) with their lengths, and what the sketch has lost."""

    n_bits: int
    directions: np.ndarray
    lengths: np.ndarray
    lost: float


def fit(df: DataFrame, bits: str, n_bits: int, columns: int, rows: int | None = None, width: int = WIDTH) -> Compression:
    """The ``columns`` longest directions of a sketch of ``rows`` rows, twice as many by default."""
    rows = rows or 2 * columns
    if rows < columns:
        raise ValueError("a sketch has at least as many rows as the result has columns")
    found = sketch(df, bits, n_bits, rows, width).toArrow()
    values = [chunk.flatten().to_numpy() for chunk in found.column("row").chunks]
    matrix = np.concatenate([np.zeros(0), *values]).reshape(found.num_rows, min(width, n_bits))
    _, lengths, directions = np.linalg.svd(matrix, full_matrices=False)
    out = np.zeros((matrix.shape[1], columns))
    n = min(columns, len(lengths))
    # The largest entry of a direction is positive.
    top = directions[:n]
    out[:, :n] = (top * np.sign(top[np.arange(n), np.abs(top).argmax(axis=1)])[:, None]).T if n else 0
    return Compression(n_bits, out, np.pad(lengths[:n], (0, columns - n)), float(np.sum(found.column("lost").to_numpy())))


def compress(df: DataFrame, bits: str, model: Compression, out: str = "fpcompressed") -> DataFrame:
    """Add ``out``, the vector along each direction; a null vector stays null. Map-only.

    The directions have a fixed size and reach the tasks as one broadcast value.
    """
    shared = df.sparkSession.sparkContext.broadcast(model.directions)
    width, n_bits = model.directions.shape[0], model.n_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                column = batch.column(batch.schema.get_field_index(bits))
                there = np.flatnonzero(~np.asarray(column.is_null()))
                values = _dense(column.take(pa.array(there)), n_bits, width) @ directions
                sizes = np.zeros(batch.num_rows, dtype=np.int32)
                sizes[there] = directions.shape[1]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                missing = pa.array(sizes == 0)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()), mask=missing)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` array<double>")
