"""Links between vectors of high cosine, by an exact metric range join.

On unit vectors a cosine of ``c`` is a distance of ``sqrt(2 - 2 c)``. Every vector belongs to the
cell of its nearest pivot and also visits the cells that the triangle inequality does not rule
out: a partner in the cell lies on the cell's side of the plane between both pivots, and within
the cell's radius. Large cells are cut into blocks of bounded size, small ones share a block. A
block's own vectors are held in memory and visitors stream past them, so blocks are joined
independently; of two blocks only one is visited, each block by about half of the others. What is
sent grows with the number of blocks, so blocks are as large as a task can hold while there are
some for every core. Equal vectors are folded before, so a very common vector is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.components import components
from sievework.llm.stored import materialize

#: Vectors of a cell, and the largest number of pivots (which bounds what is sent to tasks).
CELL, MOST_PIVOTS = 2048, 4096

#: Numbers of a block, which a task holds, blocks that smaller tables have, and numbers compared at once.
NUMBERS, BLOCKS, STEP = 1 << 21, 16, 1 << 21


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _assign(pivots: np.ndarray):
    """The cell of each vector and its distance from the pivot, on unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _unit(_rows(batch.column("v"))) @ pivots.T
                cell = near.argmax(axis=1)
                far = np.sqrt(np.maximum(2 - 2 * near.max(axis=1), 0))
                columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cell", "far"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _dealt(pivots: np.ndarray, sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each cell, and its number of blocks; 0 for a cell without vectors.

    Cells beyond ``block`` vectors have several of their own. The others share blocks of up to as
    many, with cells that lie at a similar distance from the first pivot.
    """
    blocks = -(-sizes // block)
    first = np.zeros(len(sizes), dtype=np.int64)
    following, room = 0, 0
    for cell in np.argsort(-(pivots @ pivots[0]), kind="stable"):
        if blocks[cell] > 1:
            first[cell], following, room = following, following + blocks[cell], 0
        elif blocks[cell]:
            if sizes[cell] > room:
                following, room = following + 1, block
            first[cell], room = following - 1, room - sizes[cell]
    return first, blocks


def _visits(pivots: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, blocks: np.ndarray, reach: float):
    """A row for each block that a vector belongs to (host) or has to visit."""
    most = int((first + blocks).max())
    gaps = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    slack = reach + 1e-7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                near = np.sqrt(np.maximum(2 - 2 * (_unit(_rows(batch.column("v"))) @ pivots.T), 0))
                cell = np.asarray(batch.column("cell"))
                block = first[cell] + np.asarray(batch.column("spread")) % blocks[cell]
                own = near[np.arange(len(cell)), cell]
                # Distance from the plane between the two pivots, for a vector on its own side.
                beyond = (near**2 - own[:, None] ** 2) <= 2 * slack * gaps[cell] + 1e-7
                met = beyond & (near <= high + slack) & (near >= low - slack) & (blocks > 0)
                met[np.arange(len(cell)), cell] = True
                row, seen = np.nonzero(met)
                count = blocks[seen]
                row, target = np.repeat(row, count), np.repeat(first[seen], count)
                target = target + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                # One of two blocks is visited: the lower if the sum of both is even, else the higher.
                ahead = np.where((target + block[row]) % 2 == 0, target < block[row], target > block[row])
                use = ahead | (target == block[row])
                row, target = np.divmod(np.unique(row[use] * most + target[use]), most)
                part = batch.select(["rep", "weight", "v"]).take(pa.array(row))
                host = pa.array(target == block[row])
                yield pa.RecordBatch.from_arrays([pa.array(target.astype(np.int64)), host, *part.columns], names=["block", "host", "rep", "weight", "v"])

    return run


def _by_row(row: np.ndarray, column: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    edge = np.flatnonzero(np.diff(row, prepend=-1))
    for lo, hi in zip(edge, [*edge[1:], len(row)]):
        yield int(row[lo]), column[lo:hi]


class _Block:
    """The vectors of one block, and which of them are known to be connected."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids = None

    def seal(self, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Links among the block's own vectors."""
        self.ids, self.weight, self.rows = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        self.label = np.arange(len(self.ids))
        counts, edges = np.zeros(len(self.ids)), []
        for at, row, column in self._linked(self.rows, least):
            other = at + row != column
            row, column = row[other], column[other]
            np.add.at(counts, at + row, self.weight[column])
            for k, own in _by_row(row, column):
                edges += self._join(int(self.ids[at + k]), np.append(own, at + k), at + k)
        return counts, edges

    def visit(self, ids: np.ndarray, weight: np.ndarray, rows: np.ndarray, least: float):
        """Links of visitors: their counts, what the block's vectors gain, and edges."""
        mine, theirs, edges = np.zeros(len(ids)), np.zeros(len(self.ids)), []
        for at, row, column in self._linked(rows, least):
            np.add.at(mine, at + row, self.weight[column])
            np.add.at(theirs, column, weight[at + row])
            for k, own in _by_row(row, column):
                edges += self._join(int(ids[at + k]), own, None)
        return mine, theirs, edges

    def _linked(self, rows: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Pairs of a row, counted from the first of some, and a vector of the block."""
        step = max(1, STEP // len(self.rows))
        for at in range(0, len(rows), step):
            row, column = np.divmod(np.flatnonzero(rows[at : at + step] @ self.rows.T >= least), len(self.rows))
            if len(row):
                yield at, row, column

    def _join(self, node: int, own: np.ndarray, skip: int | None) -> list[tuple[int, int]]:
        labels, first = np.unique(self.label[own], return_index=True)
        edges = [(node, int(self.ids[own[f]])) for f in first if own[f] != skip]
        if len(labels) > 1:
            self.label[np.isin(self.label, labels[1:])] = labels[0]
        return edges


def _join(least: float):
    """Counts (kind 0: a, n) and edges (kind 1: a, b) from rows sorted by block, hosts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, gained = None, _Block(), None

        def out(counts, edges) -> pa.RecordBatch:
            ids, n = counts
            some = n > 0
            a, b = (np.array(x, dtype=np.int64) for x in (zip(*edges) if edges else ((), ())))
            kind = np.repeat([0, 1], [some.sum(), len(a)]).astype(np.int32)
            columns = [kind, np.concatenate([ids[some], a]), np.concatenate([n[some].astype(np.int64), b])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "a", "b"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                blocks, host, ids, weight = (np.asarray(batch.column(c)) for c in ("block", "host", "rep", "weight"))
                rows, weight = _unit(_rows(batch.column("v"))), weight.astype(np.float64)
                edge = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (host[1:] != host[:-1])))
                for lo, hi in zip(edge, [*edge[1:], len(blocks)]):
                    if blocks[lo] != now:
                        if block.ids is not None:
                            yield out((block.ids, gained), [])
                        elif block.parts:
                            counts, edges = block.seal(least)
                            yield out((block.ids, counts), edges)
                        now, block = blocks[lo], _Block()
                    if host[lo]:
                        block.parts.append((ids[lo:hi], weight[lo:hi], rows[lo:hi]))
                        continue
                    if block.ids is None and not block.parts:
                        continue
                    if block.ids is None:
                        gained, edges = block.seal(least)
                        yield out((block.ids, np.zeros(len(block.ids))), edges)
                    mine, theirs, edges = block.visit(ids[lo:hi], weight[lo:hi], rows[lo:hi], least)
                    gained = gained + theirs
                    yield out((ids[lo:hi], mine), edges)
        if block.ids is not None:
            yield out((block.ids, gained), [])
        elif block.parts:
            counts, edges = block.seal(least)
            yield out((block.ids, counts), edges)

    return run


def range_links(vectors: DataFrame, least: float = 0.9, block: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every vector.

    ``vectors`` needs ``vec_id`` (unique, not null) and ``embedding`` (array of numbers); other
    columns are ignored. Vectors that are null, empty, zero or hold nulls or non-finite
    components link with nothing, nor do vectors of different lengths link. ``n_links`` counts
    other vectors with a cosine of at least ``least``, in double precision. ``block`` is the most
    vectors of a block, by default what ``NUMBERS`` allow and at most a share of all.
    """
    # Numbers go as they are given, which is half the bytes for floats; they are compared as doubles.
    floats = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = F.col("embedding") if floats else F.col("embedding").cast("array<double>")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ids = ids.withColumn("v", F.when(fine & F.exists("v", lambda x: x != 0), F.col("v")))
    valid = ids.filter("v is not null and vec_id is not null").withColumn("k", F.struct(F.size("v").alias("dim"), F.md5(F.concat_ws(",", F.col("v").cast("array<string>"))).alias("h")))
    classes = valid.groupBy("k").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = materialize(classes, "classes")
    reps = valid.select("vec_id", "v").join(classes.select("rep", "weight"), F.col("vec_id") == F.col("rep"))
    reps = materialize(reps.select("rep", "weight", "v"), "reps")
    found = []
    for dim in [r[0] for r in reps.select(F.size("v").alias("d")).distinct().collect()]:
        found.append(_links_of(reps.filter(F.size("v") == dim), least, dim, block))
    if not found:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    counts = links.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n"))
    named = components(links.filter("kind = 1").select("a", "b")).select(F.col("node").alias("rep"), "component")
    per = classes.join(counts, "rep", "left").join(named, "rep", "left")
    per = per.select("k", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n"), F.coalesce("component", "rep").alias("component"))
    out = valid.select("vec_id", "k").join(per, "k")
    out = ids.select("vec_id").join(out.drop("k"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )


def _links_of(reps: DataFrame, least: float, dim: int, block: int | None) -> DataFrame:
    spark = reps.sparkSession
    n, v = reps.count(), reps.schema["v"].dataType.simpleString()
    cell = block
    if block is None:
        share = -(-n // max(BLOCKS, 2 * spark.sparkContext.defaultParallelism))
        block = max(1, min(NUMBERS // dim, max(CELL, share)))
        cell = max(1, min(CELL, block // 4))
    wanted = min(max(1, -(-n // cell)), MOST_PIVOTS)
    chosen = reps.orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(wanted).select("v").collect()
    pivots = _unit(np.array([r["v"] for r in chosen], dtype=np.float64))
    assigned = reps.mapInArrow(_assign(pivots), f"rep long, weight long, v {v}, cell int, far double")
    assigned = materialize(assigned, "assigned")
    found = assigned.groupBy("cell").agg(F.min("far"), F.max("far"), F.count("*")).collect()
    low, high, sizes = np.zeros(wanted), np.zeros(wanted), np.zeros(wanted, dtype=np.int64)
    for cell, a, b, count in found:
        low[cell], high[cell], sizes[cell] = a, b, count
    first, blocks = _dealt(pivots, sizes, block)
    reach = float(np.sqrt(2 - 2 * least))
    spread = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 40))
    visits = assigned.withColumn("spread", spread).mapInArrow(
        _visits(pivots, low, high, first, blocks, reach), f"block long, host boolean, rep long, weight long, v {v}"
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int((first + blocks).max()), 10_000))
    visits = visits.repartition(parts, "block").sortWithinPartitions("block", F.desc("host"), "rep")
    return materialize(visits.mapInArrow(_join(least), "kind int, a long, b long"), "links")
