"""A graph of nearest neighbours, and a two-dimensional view drawn from it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.hashing import uniform
from sievework.operators.ranking import running_totals
from sievework.operators.reduce import sign_matrix
from sievework.session import materialize

# Directions along which vectors are ordered for their first neighbours.
DIRECTIONS = 3

# Places to either side, along every direction, that make a first neighbour.
REACH = 2

# Columns iterated together for the view; the two leading ones are drawn.
BLOCK = 8

# Products between two orthogonalisations.
STEPS = 4


def _entries(df: DataFrame, feature: str) -> Column:
    """The vector as numbers; single precision is kept, being half as much to send."""
    single = df.schema[feature].dataType.simpleString() == "array<float>"
    return F.col(feature) if single else F.col(feature).cast("array<double>")


def distinct_vectors(df: DataFrame, key: str, feature: str) -> DataFrame:
    """``(k, x, copies)``: one row per distinct usable vector, under its smallest key.

    Rows without key, null vectors, empty ones and ones that hold null or non-finite entries
    are left out. A vector that a third of all rows hold is folded before it is shuffled.
    """
    x = _entries(df, feature)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = df.select(F.col(key).alias("k"), x.alias("x")).filter(F.col("k").isNotNull() & F.col("x").isNotNull())
    rows = rows.filter((F.size("x") > 0) & F.forall("x", finite))
    return rows.groupBy("x").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("copies")).select("k", "x", "copies")


def _dot(x: str, weights: list[float]) -> Column:
    terms = F.zip_with(F.col(x), F.lit(weights), lambda a, b: a.cast("double") * b)
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def _squared(a: str, b: str) -> Column:
    gaps = F.zip_with(F.col(a), F.col(b), lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, t: s + t)


def numbered(df: DataFrame, key: str, feature: str) -> DataFrame:
    """Distinct vectors with their places ``p0``, ``p1``, ... along some directions; ``p0`` is
    the number by which they are known from here on. All vectors must have one length."""
    points = materialize(distinct_vectors(df, key, feature), "vectors")
    sizes = points.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} entries")
    if sizes[0] is None:
        places = [F.lit(None).cast("bigint").alias(f"p{i}") for i in range(DIRECTIONS)]
        return points.select("*", *places)
    signs = sign_matrix(sizes[0], DIRECTIONS, 7)
    for i in range(DIRECTIONS):
        placed = points.withColumn("_at", _dot("x", signs[:, i].tolist()))
        points = materialize(running_totals(placed, {f"p{i}": F.lit(1)}, "_at", "k").drop("_at"), "places")
    return points


def first_links(points: DataFrame) -> DataFrame:
    """``(v, u, d, fresh)``: links to the next vectors along every direction, both ways."""
    met = []
    for i in range(DIRECTIONS):
        ahead = points.select("p0", F.explode(F.array(*[F.col(f"p{i}") + j for j in range(1, REACH + 1)])).alias("at"))
        met.append(ahead.join(points.select(F.col(f"p{i}").alias("at"), F.col("p0").alias("other")), "at"))
    pairs = reduce(DataFrame.unionByName, met).select(
        F.least("p0", "other").alias("a"), F.greatest("p0", "other").alias("b")
    ).distinct()
    a = points.select(F.col("p0").alias("a"), F.col("x").alias("ax"))
    b = points.select(F.col("p0").alias("b"), F.col("x").alias("bx"))
    known = pairs.join(a, "a").join(b, "b").select("a", "b", _squared("ax", "bx").alias("d"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u"))))
    return known.select(ends.alias("e"), "d").select("e.v", "e.u", "d", F.lit(True).alias("fresh"))


def _best(links: DataFrame, width: int) -> DataFrame:
    nearest = Window.partitionBy("v").orderBy("d", "u")
    return links.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= width)


def _nearest(v: np.ndarray, u: np.ndarray, d: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Each pair once, and of each ``v`` only the ``width`` first ones: no other can become a link."""
    order = np.lexsort((u, d, v))
    v, u, d = v[order], u[order], d[order]
    once = np.ones(len(v), bool)
    once[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
    v, u, d = v[once], u[once], d[once]
    place = np.arange(len(v)) - np.searchsorted(v, v)
    return tuple(c[place < width] for c in (v, u, d))


def _compare(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Pairs within each row's members, one of them fresh, nearer than the first one's last link."""
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten()
        m = flat.field("m").to_numpy(zero_copy_only=False)
        fresh = flat.field("fresh").to_numpy(zero_copy_only=False)
        last = flat.field("last").to_numpy(zero_copy_only=False)
        x = flat.field("x").flatten().to_numpy(zero_copy_only=False)
        x = x.astype(np.float64).reshape(len(m), -1) if len(m) else np.empty((0, 1))
        x_sq = np.einsum("ij,ij->i", x, x)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, e in zip(np.concatenate([[0], ends[:-1]]), ends):
            y, sq = x[s:e], x_sq[s:e]
            rough = sq[:, None] + sq - 2 * (y @ y.T)
            slack = 1e-12 * (sq[:, None] + sq)
            near = (rough <= last[s:e, None] + slack) & (fresh[s:e, None] | fresh[s:e])
            np.fill_diagonal(near, False)
            i, j = np.nonzero(near)
            d = np.square(y[i] - y[j]).sum(axis=1)
            keep = d < last[s:e][i]
            out.append((m[s:e][i[keep]], m[s:e][j[keep]], d[keep]))
        v, u, d = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        v, u, d = _nearest(v, u, d, width)
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u), pa.array(d)], names=["v", "u", "d"])


def _improve(points: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """One round: whoever is linked with the same vector is compared.

    A vector's own links are at most ``width``; those that others have with it may be many, and
    are dealt to pieces of about ``width``. Its own links go to every piece, so no link is left
    out and no group grows with a hub's fame. Groups without a fresh link are not sent.
    """
    pieces = links.groupBy(F.col("u").alias("c")).agg(F.ceil(F.count(F.lit(1)) / width).alias("pieces"))
    of = links.select(F.col("u").alias("c"), F.col("v").alias("m"), "fresh").join(pieces, "c")
    of = of.select("c", F.pmod(F.xxhash64("m"), "pieces").alias("piece"), "m", "fresh")
    own = links.select(F.col("v").alias("c"), F.col("u").alias("m"), "fresh").join(pieces, "c", "left")
    own = own.select("c", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"), "m", "fresh")
    members = of.unionByName(own).groupBy("c", "piece", "m").agg(F.max("fresh").alias("fresh"))
    group = Window.partitionBy("c", "piece")
    members = members.withColumn("any", F.max("fresh").over(group)).filter("any").drop("any")
    # A list that is not full takes anything.
    last = links.groupBy(F.col("v").alias("m")).agg(
        F.when(F.count(F.lit(1)) >= width, F.max("d")).otherwise(F.lit(float("inf"))).alias("last")
    )
    vectors = points.select(F.col("p0").alias("m"), "x").join(last, "m")
    member = F.struct("m", "fresh", "last", "x")
    groups = members.join(vectors, "m").groupBy("c", "piece").agg(F.collect_list(member).alias("members"))
    found = groups.select("members").mapInArrow(partial(_compare, width=width), "v bigint, u bigint, d double")
    both = links.select("v", "u", "d", F.lit(False).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(True)))
    # By v alone, which serves the sums and the choice after them.
    return _best(both.repartition("v").groupBy("v", "u").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh")), width)


def linked(points: DataFrame, width: int, rounds: int, settled: float) -> DataFrame:
    """Rounds of improvement until less than ``settled`` of the links are fresh."""
    links = materialize(_best(first_links(points), width), "links")
    for _ in range(rounds):
        links = materialize(_improve(points, links, width), "links")
        count = links.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if count[1] <= settled * count[0]:
            break
    return links


def neighbour_graph(
    df: DataFrame, key: str, feature: str, k: int = 10, width: int | None = None, rounds: int = 12, settled: float = 0.001
) -> DataFrame:
    """``(key, neighbour, distance, place)``: each distinct vector's ``k`` nearest others.

    Distances are Euclidean, exact, and ties go to the vector that comes first along the first
    direction. The neighbours are found by improvement: vectors start out linked with those
    next to them along some directions, and in every round vectors that are linked with the
    same one are compared. ``width`` links are kept meanwhile (twice ``k`` by default); more of
    them find more. The number of rows sent in a round is in proportion to vectors times
    ``width``. Some neighbours may be missed, ever more the less the vectors are structured.

    Copies of a vector are one row here, see ``distinct_vectors``, which also says what is left
    out. With fewer than ``k`` others all that were met are returned; an empty table gives none.
    """
    if k < 1 or (width is not None and width < k):
        raise ValueError("k must be at least 1, width at least k")
    points = numbered(df, key, feature)
    links = linked(points, width or 2 * k, rounds, settled).filter(F.col("place") <= k)
    ends = lambda name, number: points.select(F.col("k").alias(name), F.col("p0").alias(number))
    named = links.join(ends("_from", "v"), "v").join(ends("_to", "u"), "u")
    return named.select(F.col("_from").alias(key), F.col("_to").alias("neighbour"), F.sqrt("d").alias("distance"), "place")


def _mixed(columns: list[str], matrix: np.ndarray, names: list[str]) -> list[Column]:
    """Columns times a small matrix."""
    return [
        reduce(Column.__add__, [F.col(c) * float(w) for c, w in zip(columns, matrix[:, j])]).alias(name)
        for j, name in enumerate(names)
    ]


def _products(state: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    sums = state.agg(*[F.sum(F.col(a) * F.col(b)) for a in left for b in right]).first()
    return np.array(sums, dtype=float).reshape(len(left), len(right))


def _orthonormal(state: DataFrame, columns: list[str]) -> DataFrame:
    """The same span in orthonormal columns; directions that vanished become zero."""
    gram = _products(state, columns, columns)
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    values, vectors = np.linalg.eigh(gram / np.outer(scale, scale))
    factors = np.where(values > 1e-10, 1 / np.sqrt(np.maximum(values, 1e-10)), 0.0)
    return state.select("v", "mass", *_mixed(columns, (vectors * factors) / scale[:, None], columns))


def _without_mass(state: DataFrame, columns: list[str]) -> DataFrame:
    """Columns without their part along the known leading direction, the root of the masses."""
    root = F.sqrt("mass")
    sums = state.agg(F.sum("mass"), *[F.sum(F.col(c) * root) for c in columns]).first()
    shares = [s / sums[0] for s in sums[1:]]
    return state.select("v", "mass", *[(F.col(c) - F.lit(s) * root).alias(c) for c, s in zip(columns, shares)])


def graph_view(
    df: DataFrame, key: str, feature: str, k: int = 10, width: int | None = None, rounds: int = 12, turns: int = 8
) -> DataFrame:
    """``(key, x, y)``: two coordinates in which linked vectors lie close together.

    Links of the neighbour graph weigh ``exp(-d^2 / (reach * reach))`` with both ends' distance
    to their last neighbour as reaches. The coordinates are the two leading directions of the
    weights normalised by their sums, after the constant one, by power iteration on a block of
    columns; a product is one join and one sum. The driver holds matrices of ``BLOCK`` by
    ``BLOCK``. Signs are arbitrary. Every row with a usable vector gets its vector's place; a
    single distinct vector lies at the origin.
    """
    points = numbered(df, key, feature)
    if points.limit(2).count() < 2:
        zero = F.lit(0.0)
        placed = points.select(F.col("x").alias("_x"), zero.alias("x"), zero.alias("y"))
        return _of_rows(df, placed, key, feature)
    links = linked(points, width or 2 * k, rounds, 0.001).filter(F.col("place") <= k)
    reach = links.groupBy("v").agg(F.greatest(F.sqrt(F.max("d")), F.lit(1e-150)).alias("reach"))
    pulled = links.join(reach, "v").join(reach.select(F.col("v").alias("u"), F.col("reach").alias("far")), "u")
    weight = F.exp(-F.col("d") / F.col("reach") / F.col("far"))
    ends = F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u"))))
    weights = pulled.select(ends.alias("e"), weight.alias("w")).groupBy("e.v", "e.u").agg(F.max("w").alias("w"))
    weights = materialize(weights, "weights")
    mass = materialize(weights.groupBy("v").agg(F.greatest(F.sum("w"), F.lit(1e-300)).alias("mass")), "masses")
    normal = weights.join(mass, "v").join(mass.select(F.col("v").alias("u"), F.col("mass").alias("_m")), "u")
    normal = normal.select("v", "u", (F.col("w") / F.sqrt(F.col("mass") * F.col("_m")) / 2).alias("w"))
    # Half the identity keeps all values of the matrix positive.
    walk = materialize(normal.unionByName(mass.select("v", F.col("v").alias("u"), F.lit(0.5).alias("w"))), "walk")

    columns = [f"c{i}" for i in range(BLOCK)]
    # Half of the block starts from the vectors, half from hashes: vectors of few dimensions
    # span too little on their own.
    signs = sign_matrix(points.select(F.size("x")).first()[0], BLOCK // 2, 11)
    starts = [
        (_dot("x", signs[:, i].tolist()) if i < BLOCK // 2 else uniform(F.col("v"), i) - 0.5).alias(c)
        for i, c in enumerate(columns)
    ]
    state = points.withColumnRenamed("p0", "v").join(mass, "v").select("v", "mass", *starts)

    def product(state: DataFrame) -> DataFrame:
        other = state.select(F.col("v").alias("u"), *columns)
        sums = walk.join(other, "u").groupBy("v").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])
        return sums.join(mass, "v").select("v", "mass", *columns)

    for _ in range(turns):
        state = materialize(_orthonormal(materialize(_without_mass(materialize(state, "state"), columns), "state"), columns), "state")
        for _ in range(STEPS):
            state = product(state)
    state = materialize(_without_mass(materialize(state, "state"), columns), "state")
    state = materialize(_orthonormal(state, columns), "state")
    after = product(state).select("v", *[F.col(c).alias(f"m{c}") for c in columns])
    inner = _products(state.join(after, "v"), columns, [f"m{c}" for c in columns])
    _, vectors = np.linalg.eigh((inner + inner.T) / 2)
    plane = state.select("v", "mass", *_mixed(columns, vectors[:, ::-1][:, :2], ["x", "y"]))
    plane = plane.select(F.col("v").alias("p0"), *[(F.col(c) / F.sqrt("mass")).alias(c) for c in ("x", "y")])
    return _of_rows(df, points.select("p0", F.col("x").alias("_x")).join(plane, "p0").drop("p0"), key, feature)


def _of_rows(df: DataFrame, placed: DataFrame, key: str, feature: str) -> DataFrame:
    rows = df.select(F.col(key).alias("_k"), _entries(df, feature).alias("_x")).filter("_k is not null")
    return rows.join(placed, "_x").select(F.col("_k").alias(key), "x", "y")
