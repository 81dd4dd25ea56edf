"""Near-duplicate documents by SetSketch registers.

A document's set holds the hashes of its word shingles. A sketch has ``REGISTERS`` registers; a
register is the minimum of an own hash over the set, as an exponential variate, truncated to a
power of ``BASE``. Registers of a union are the maxima of registers, and two sets agree in a
register with about their Jaccard similarity.

1. Documents with equal sets fold into one class, whose smallest id stands for it.
2. Bands of registers deal classes into buckets. In a bucket every class meets the smallest only.
3. Pairs are estimated by likelihood from how many registers are greater, smaller and equal, then
   confirmed on the full sets.
4. Where the other members of a bucket belong to several components, they form a family with all
   that share such a bucket. Families are cut into blocks by size class and hash; each pair of
   blocks whose sizes allow links is one task, which intersects the full sets as a matrix product
   and returns only links that join components. So pairs are never listed, a bucket of mutual
   copies costs as many pairs as it has members, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.arrays import U64, mix, runs_of, steps, utf8, word_hashes
from sievework.llm.components import components
from sievework.llm.stored import materialize

#: Registers, rows of a band, and the base of their exponential spacing. A pair at similarity 0.8
#: shares no band with probability (1 - 0.8**4)**24 = 3e-6, at 0.9 with 1e-11.
REGISTERS, BAND, BASE, RATE = 96, 4, 1.001, 20.0
#: Pairs whose estimate is this far below the threshold are not confirmed: over six standard
#: deviations of an estimate from 96 registers.
MARGIN = 0.26
#: Members of a family that one task compares with as many others at once, and the set items
#: that are put into matrices at once.
BLOCK, STEP_ITEMS = 256, 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_KEYS = mix(np.arange(1, 2 * REGISTERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_XOR, _ODD = _KEYS[:REGISTERS, None], _KEYS[REGISTERS:, None] | U64(1)


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    begin, end = runs_of(~_SPACE[data], starts)
    words = word_hashes(_LOWER[data], begin, end) if len(begin) else np.zeros(0, U64)
    first = np.searchsorted(begin, starts)
    coef = _KEYS[:size] | U64(1)
    n = max(len(words) - size + 1, 0)
    shingles = np.zeros(n, U64)
    for j in range(size):
        shingles += words[j : j + n] * coef[j]
    shingles = mix(shingles)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(shingles[a : b - size + 1])
        elif b > a:
            short = words[a:b] * coef[: b - a]
            yield mix(short.sum(dtype=U64, keepdims=True) ^ (U64(b - a) << U64(48)))
        else:
            yield np.zeros(0, U64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Truncated minima of a non-empty set, spaced by powers of ``BASE``."""
    low = np.full((REGISTERS, 1), np.iinfo(U64).max, dtype=U64)
    for at in range(0, len(shingles), 4096):
        part = (shingles[None, at : at + 4096] ^ _XOR) * _ODD
        low = np.minimum(low, part.min(axis=1, keepdims=True))
    variate = -np.log1p(-(low[:, 0].astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1.0 - np.log(variate) / np.log(BASE)), 0, 65535).astype(">u2")


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(1))
            ids = batch.column(0)
            for a, b in steps(starts):
                n, one, two, regs = [], [], [], []
                part = data[starts[a] : starts[b]]
                for s in shingle_sets(part, starts[a : b + 1] - starts[a], size):
                    n.append(len(s))
                    one.append(s.sum(dtype=U64))
                    two.append(mix(s + U64(1)).sum(dtype=U64))
                    regs.append(registers(s).tobytes() if len(s) else None)
                sums = [pa.array(np.array(x, dtype=U64).view(np.int64)) for x in (one, two)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), *sums, pa.array(regs, pa.binary())],
                    names=["doc_id", "n", "h1", "h2", "regs"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(1))
            for a, b in steps(starts):
                part = data[starts[a] : starts[b]]
                sets = [s.view(np.int64) for s in shingle_sets(part, starts[a : b + 1] - starts[a], size)]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), flat)],
                    names=["doc_id", "items"],
                )

    return run


def likely_jaccard(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The similarity under which the counts of greater, smaller and equal registers are likeliest."""
    more = (x > y).sum(axis=-1)[..., None]
    less = (x < y).sum(axis=-1)[..., None]
    same = x.shape[-1] - more - less
    u = (nx / (nx + ny))[..., None]
    v = 1.0 - u
    grid = np.minimum(u / v, v / u) * np.linspace(0.0, 1.0, 101)

    def p(z):
        return -np.log1p(-np.clip(z, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * grid), p(v - u * grid)
    tiny = 1e-12
    fit = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))
    return np.take_along_axis(grid, fit.argmax(axis=-1)[..., None], axis=-1)[..., 0]


def _matrix(column: pa.Array) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=">u2")
    return data.reshape(-1, REGISTERS).astype(np.uint16)


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                na, nb = (np.asarray(batch.column(c), dtype=np.float64) for c in ("na", "nb"))
                fit = likely_jaccard(_matrix(batch.column("ra")), _matrix(batch.column("rb")), na, nb)
                yield batch.select(["a", "b"]).filter(pa.array(fit >= least))

    return run


def _intersections(items: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray, rows: int) -> np.ndarray:
    """Sizes of the intersections of the sets in ``left`` with those in ``right``."""
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    parts = len(items) // STEP_ITEMS + 1
    for part in range(parts):
        mine = items % U64(parts) == part if parts > 1 else slice(None)
        _, code, times = np.unique(items[mine], return_inverse=True, return_counts=True)
        shared = times[code] > 1
        code, who = code[shared], owner[mine][shared]
        order = np.argsort(code, kind="stable")
        code, who = code[order], who[order]
        code = np.cumsum(np.diff(code, prepend=code[:1]) != 0)
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            lo, hi = np.searchsorted(code, [at, at + 4096])
            held = np.zeros((rows, 4096), dtype=np.float32)
            held[who[lo:hi], code[lo:hi] - at] = 1.0
            total += held[left] @ held[right].T
    return total


def _joining_links(percent: int):
    """Links between (or within) two blocks of a family that join different components."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, comp, n, block = (np.asarray(table.column(c).combine_chunks()) for c in ("doc_id", "component", "n", "block"))
        lists = table.column("items").combine_chunks()
        items = np.asarray(lists.flatten()).view(U64)
        owner = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
        one, two = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        both = _intersections(items, owner, left, right, len(ids))
        linked = 100 * both >= percent * (n[left][:, None] + n[right][None] - both)
        linked &= comp[left][:, None] != comp[right][None]
        x, y = np.nonzero(linked)
        x, y = left[x], right[y]
        pairs = np.stack([np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])], axis=1)
        pairs, first = np.unique(pairs, axis=0, return_index=True) if len(x) else (pairs, np.zeros(0, int))
        above: dict[int, int] = {}

        def root(c: int) -> int:
            while above.get(c, c) != c:
                c = above[c]
            return c

        kept = []
        for (c, d), at in zip(pairs.tolist(), first):
            c, d = root(c), root(d)
            if c != d:
                above[max(c, d)] = min(c, d)
                kept.append(at)
        return pa.table({"a": ids[x[kept]].astype(np.int64), "b": ids[y[kept]].astype(np.int64)})

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document.

    ``docs`` needs ``doc_id`` (unique, not null) and ``text``; further columns are ignored. Words
    are runs of bytes other than white space, A-Z in lower case. A set holds the distinct
    ``size``-word shingles; fewer words form one shingle; without words the set is empty and
    linked with nothing, as is a row without id, whose component is null. Two documents are linked
    if ``100 * intersection >= percent * union``. An empty table gives an empty result.
    """
    least = percent / 100 - MARGIN
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialize(
        texts.mapInArrow(_sketches(size), "doc_id long, n long, h1 long, h2 long, regs binary"), "sketches"
    )
    classes = sketches.filter("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = sketches.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    reps = materialize(reps.select("doc_id", "n", "regs"), "reps")

    bands = [F.xxhash64(F.lit(k), F.substring("regs", 1 + 2 * BAND * k, 2 * BAND)) for k in range(REGISTERS // BAND)]
    members = reps.select("doc_id", F.explode(F.array(*bands)).alias("bucket"))
    centres = members.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.count("*").alias("k")).filter("k > 1")
    members = materialize(members.join(centres, "bucket"), "members")
    involved = members.select("doc_id").distinct()
    wanted = texts.join(involved, "doc_id", "left_semi")
    sets = materialize(wanted.mapInArrow(_sets(size), "doc_id long, items array<bigint>"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose full sets are similar enough."""
        both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
        both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        both = both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y")).alias("s"))
        return materialize(both.filter(f"100 * i >= {int(percent)} * (s - i)").select("a", "b"), "confirmed")

    stars = members.filter("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b"))
    stars = stars.distinct()
    for side, other in (("a", "ra"), ("b", "rb")):
        own = reps.select(F.col("doc_id").alias(side), F.col("n").alias(f"n{side}"), F.col("regs").alias(other))
        stars = stars.join(own, side)
    stars = stars.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_likely(least), "a long, b long")
    links = confirmed(materialize(stars, "stars"))
    found = components(links)
    more = materialize(_family_links(members, reps, sets, found, percent), "family-links")
    found = components(materialize(links.unionByName(more), "links"))

    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("n", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("doc_id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _family_links(members: DataFrame, reps: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links within families; pairs with a bucket's smallest member have been decided before."""
    others = members.filter("doc_id <> centre").select("bucket", "doc_id")
    named = others.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = named.withColumn("component", F.coalesce("component", "doc_id"))
    mixed = named.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("doc_id").alias("lead")
    )
    mixed = mixed.filter("lo <> hi").select("bucket", "lead")
    near = materialize(named.join(mixed, "bucket").select("doc_id", "lead", "component").distinct(), "near")
    family = components(near.select(F.col("doc_id").alias("a"), F.col("lead").alias("b")))
    rows = family.select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    rows = rows.join(near.select("doc_id", "component").distinct(), "doc_id").join(reps.select("doc_id", "n"), "doc_id")
    # Sizes of linked sets differ by one class at most.
    rows = rows.withColumn("class", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent))).cast("int"))
    rows = materialize(rows, "family")
    sizes = rows.groupBy("family", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    after = sizes.select("family", (F.col("class") - 1).alias("class"), F.col("blocks").alias("next"))
    before = sizes.select("family", (F.col("class") + 1).alias("class"), F.col("blocks").alias("last"))
    sizes = sizes.join(after, ["family", "class"], "left").join(before, ["family", "class"], "left")
    rows = rows.join(sizes, ["family", "class"])

    def name(kind, number):
        return F.concat_ws(":", kind, number)

    def numbers(count):
        return F.filter(F.sequence(F.lit(0), F.coalesce(count, F.lit(0))), lambda k: k < F.coalesce(count, F.lit(0)))

    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("block", name(F.col("class"), F.col("own")))
    pairs = F.concat(
        F.transform(
            numbers(F.col("blocks")),
            lambda o: F.struct(name(F.col("class"), F.least(o, F.col("own"))).alias("one"), name(F.col("class"), F.greatest(o, F.col("own"))).alias("two")),
        ),
        F.transform(numbers(F.col("next")), lambda o: F.struct(F.col("block").alias("one"), name(F.col("class") + 1, o).alias("two"))),
        F.transform(numbers(F.col("last")), lambda o: F.struct(name(F.col("class") - 1, o).alias("one"), F.col("block").alias("two"))),
    )
    rows = rows.join(sets, "doc_id").withColumn("pair", F.explode(pairs))
    rows = rows.select("family", "pair.one", "pair.two", "block", "doc_id", "component", "n", "items")
    return rows.groupBy("family", "one", "two").applyInArrow(_joining_links(percent), "a long, b long")
