"""Similarity of fingerprints: paired, and as a self-join."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.features import same_bits, tanimoto
from sievework.session import materialize_freed as materialize

# How many of the most common bits are told apart when bits are ordered.
COMMON_BITS = 20_000

# Bits are counted in ranges of ``2**RANGE_BITS``, and one by one in so many of these.
RANGE_BITS = 14
FULL_RANGES = 4096

# Bits are dealt anew by ``(bit * a + b) % PRIME``; products of two such numbers fit a bigint.
PRIME = 2**31 - 1

# Bits whose places are worked out at once in a task.
STEP_BITS = 1 << 20

# Sets that are looked at together in a task.
STEP_SETS = 2048

# Bits that two sets share among the first ones of each before the whole sets are compared.
SHARED = 8

# First bits that meet at once, which bounds the disk they take, and the most rounds they are cut
# into: a round reads all sets again.
ROUND_BITS = 1 << 25
ROUNDS = 4

# Pairs that are checked in one task, with the sets of all of them.
TILE_PAIRS = 100_000


def compare_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Add equality and Tanimoto similarity of two fingerprint columns."""
    a, b = F.col(left), F.col(right)
    return pairs.withColumn("all_equal", same_bits(a, b)).withColumn("tanimoto", tanimoto(a, b))


def distinct_fingerprints(df: DataFrame, key: str, bits: str) -> DataFrame:
    """One row per distinct non-empty fingerprint: first key, number of copies, bits."""
    work = df.select(F.md5(F.array_join(bits, ",")).alias("_d"), key, bits)
    sets = work.groupBy("_d").agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies"), F.first(bits).alias(bits)
    )
    # Filtered last: further down, the filter would compute the fingerprints once more.
    return sets.filter(F.size(bits) > 0).drop("_d")


def fold_sets(df: DataFrame, key: str, bits: str) -> DataFrame:
    """``distinct_fingerprints``, stored, as ``similar_pairs`` and ``similar_pairs_sampled`` read them."""
    return materialize(distinct_fingerprints(df, key, bits).withColumnRenamed(key, "k"), "sets")


def _common_places(sets: DataFrame, bits: str) -> np.ndarray:
    """The most common bits, the rarest of them first; at most ``COMMON_BITS``.

    Bits are counted in ranges first, which a task sums up before anything is sent, and one by
    one in the fullest ranges only: most bits of wide fingerprints are in one set.
    """
    tokens = sets.select(F.explode(bits).alias("t")).filter("t is not null")
    span = F.shiftright("t", RANGE_BITS)
    full = tokens.groupBy(span.alias("span")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "span").limit(FULL_RANGES)
    inside = tokens.withColumn("span", span).join(F.broadcast(full.select("span")), "span", "left_semi")
    usage = inside.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = usage.orderBy(F.desc("n"), F.desc("t")).limit(COMMON_BITS).toArrow()
    return found.column("t").to_numpy()[::-1].astype(np.int64)


def _mixed(bits: np.ndarray) -> np.ndarray:
    x = bits.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _prefixes(common: Broadcast, least: float, part: int, parts: int):
    """Rows ``(k, t, size, pos, before)``: the first bits of every set, those of one of ``parts``
    only, and a 64-bit digest of the ``SHARED`` bits before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(common.value)
        known = common.value[order]
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_SETS):
                batch = whole.slice(at, STEP_SETS)
                lists = batch.column(1)
                flat = np.asarray(lists.flatten()).astype(np.int64)
                sizes = np.asarray(lists.value_lengths()).astype(np.int64)
                rows = np.repeat(np.arange(len(sizes)), sizes)
                place = np.zeros(len(flat), dtype=np.int64)
                if len(known):
                    near = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    place = np.where(known[near] == flat, order[near] + 1, 0)
                # Common bits come last, whatever their position.
                flat = flat[np.lexsort((flat, place, rows))]
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                # The small amount keeps float rounding from excluding a pair that just fits.
                prefix = sizes - np.ceil(sizes * least - 1e-9).astype(np.int64) + SHARED
                take = np.flatnonzero((pos < prefix[rows]) & (flat % parts == part))
                of = rows[take]
                mixed = _mixed(flat)
                before = np.zeros(len(take), dtype=np.uint64)
                for i in range(1, SHARED + 1):
                    before = before * np.uint64(0x9E3779B97F4A7C15) + mixed[take - i]
                before = before.view(np.int64)
                numbers = [pa.array(v[take].astype(np.int32)) for v in (flat, sizes[rows], pos)]
                columns = [batch.column(0).take(pa.array(of)), *numbers, pa.array(before)]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "t", "size", "pos", "before"])

    return run


def _common_bits(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """``(a, b, total, common)`` of the pairs of one tile, whose sets are all there."""
    names = pc.unique(sets.column("k").combine_chunks())
    number = lambda column: pc.index_in(column, value_set=names).to_numpy().astype(np.int64)
    of = number(sets.column("k"))
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(len(names) + 1))
    a, b = number(pairs.column("a")), number(pairs.column("b"))
    # A key with several sets stands for each of them.
    left, right = np.diff(first)[a], np.diff(first)[b]
    row = np.repeat(np.arange(len(a)), left * right)
    step = np.arange(len(row)) - np.repeat(np.cumsum(left * right) - left * right, left * right)
    x = order[first[a[row]] + step // right[row]]
    y = order[first[b[row]] + step % right[row]]

    lists = sets.column("bits").combine_chunks()
    lengths = np.asarray(lists.value_lengths()).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    values, flat = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    mark = np.zeros(len(values), dtype=np.int64)
    common = np.zeros(len(x), dtype=np.int64)
    by_left = np.argsort(x, kind="stable")
    cuts = np.flatnonzero(np.diff(x[by_left], prepend=-1))
    for at, stop in zip(cuts, np.append(cuts[1:], len(x))):
        own = flat[starts[x[by_left[at]]] :][: lengths[x[by_left[at]]]]
        mark[own] = 1
        for low in range(at, stop, STEP_SETS):
            here = by_left[low : min(low + STEP_SETS, stop)]
            others = lengths[y[here]]
            ends = np.cumsum(others)
            places = np.arange(ends[-1]) + np.repeat(starts[y[here]] - ends + others, others)
            common[here] = np.add.reduceat(mark[flat[places]], ends - others)
        mark[own] = 0
    size = np.asarray(sets.column("size").combine_chunks()).astype(np.int64)
    columns = [pairs.column(c).take(pa.array(row)) for c in ("a", "b")]
    return pa.table([*columns, pa.array(size[x] + size[y]), pa.array(common)], names=["a", "b", "total", "common"])


def _checked(met: DataFrame, sets: DataFrame, bits: str, least: float) -> DataFrame:
    """The pairs ``(a_k, b_k)`` of ``met`` whose whole sets are similar enough.

    Sets that meet mostly come in families, so pairs are dealt to tiles by the smallest key that
    one of them met, and a set goes to a tile once, not with every pair. The pairs of a large
    family are dealt to a square of tiles by both their keys. A tile has some ``TILE_PAIRS``
    pairs and at most twice as many sets, and small families share one.
    """
    met = met.select(F.least("a_k", "b_k").alias("a"), F.greatest("a_k", "b_k").alias("b")).distinct()
    met = materialize(met, "met")
    kind = sets.schema["k"].dataType.simpleString()
    ends = F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("b").alias("o")), F.struct(F.col("b").alias("k"), F.col("a").alias("o"))))
    lead = met.select(ends.alias("e")).groupBy("e.k").agg(F.min("e.o").alias("o")).select(F.col("k").alias("a"), F.least("k", "o").alias("lead"))
    family = F.xxhash64("lead")
    placed = materialize(met.join(lead, "a").select("a", "b", family.alias("family")), "placed")
    sizes = placed.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    shared = 1 + placed.count() // TILE_PAIRS
    # Fewer than pairs over TILE_PAIRS.
    large = sizes.filter(F.col("n") > TILE_PAIRS).select("family", F.ceil(F.sqrt(F.col("n") / TILE_PAIRS)).alias("side"))
    at = lambda key: F.when(F.col("side").isNull(), 0).otherwise(F.pmod(F.xxhash64(key), "side"))
    pairs = placed.join(F.broadcast(large), "family", "left").select(
        F.when(F.col("side").isNull(), F.pmod("family", F.lit(shared))).otherwise(F.col("family")).alias("family"),
        at("a").alias("row"), at("b").alias("column"), "a", "b",
    )
    tile = ["family", "row", "column"]
    # Under names of their own, since both sides of the cogroup come from the same table.
    there = pairs.select(*[F.col(c).alias(f"_{c}") for c in tile], F.explode(F.array("a", "b")).alias("k")).distinct()
    # As array_intersect has it: every bit once, null like any other.
    whole = F.array_distinct(F.transform(bits, lambda t: F.coalesce(t, F.lit(-1)))).alias("bits")
    members = there.join(sets.select("k", F.size(bits).alias("size"), whole), "k")
    both = pairs.groupBy(*tile).cogroup(members.groupBy(*[f"_{c}" for c in tile])).applyInArrow(_common_bits, f"a {kind}, b {kind}, total bigint, common bigint")
    similarity = F.col("common") / (F.col("total") - F.col("common"))
    return materialize(both.select("a", "b", similarity.alias("tanimoto")).filter(F.col("tanimoto") >= least), "similar")


def similar_pairs(df: DataFrame, key: str, bits: str, least: float, sets: DataFrame | None = None) -> DataFrame:
    """All pairs of distinct fingerprints with Tanimoto similarity of at least ``least``.

    Copies are folded first, so a fingerprint shared by a third of all rows is one row here
    (``distinct_fingerprints`` tells how many rows it stands for) and pairs of copies, which
    are known to be equal, are never listed one by one.

    With the bits of every set in one global order, two sets that similar share ``SHARED`` bits
    among the first ``size - ceil(least * size) + SHARED`` of each, if they need to share as many.
    Only those are joined, common bits ordered last. At one of the first ``SHARED`` bits that two
    sets share, no more can be common than what is left of either and the ones before, so places
    that leave too little are dropped; so are those behind as many shared bits (known by a digest),
    as the pair has been met often enough there already. What was met often enough is checked
    exactly. Many first bits meet in rounds, a share of all bits in each, and the shuffle of a round
    is given back before the next.

    ``sets`` is what ``fold_sets`` returned, where it is there already. Meant for wide fingerprints
    (2**31 - 1 positions): a narrow one has no rare bits.
    """
    if not 0.0 < least <= 1.0:
        raise ValueError("least must lie in (0, 1]")
    sets = fold_sets(df, key, bits) if sets is None else sets
    # Any order gives the same pairs; knowing the most common bits only makes it cheaper.
    common = df.sparkSession.sparkContext.broadcast(_common_places(sets, bits))
    kind = sets.schema["k"].dataType.simpleString()
    whole = sets.select("k", F.array_compact(bits).alias("bits"))
    firsts = sets.agg(F.sum(F.size(bits) * F.lit(1 - least) + SHARED)).first()[0] or 0
    rounds = min(ROUNDS, 1 + int(firsts) // ROUND_BITS)
    met = [_meetings(whole.mapInArrow(_prefixes(common, least, i, rounds), f"k {kind}, t int, size int, pos int, before bigint"), least) for i in range(rounds)]
    if rounds > 1:
        met = [materialize(m, "meetings") for m in met]
        met = [reduce(DataFrame.unionByName, met).groupBy("a_k", "b_k").agg(F.sum("times").alias("times"), F.min("needed").alias("needed"))]
    often = F.col("times") >= F.least(F.lit(float(SHARED)), "needed")
    return _checked(met[0].filter(often).select("a_k", "b_k"), sets, bits, least)


def _meetings(entry: DataFrame, least: float) -> DataFrame:
    """``(a_k, b_k, times, needed)``: how often two sets meet, and how many bits they need to share."""
    # All conditions look at both sides, so that one shuffle of the entries serves both.
    a = entry.select([F.col(c).alias(f"a_{c}") for c in entry.columns])
    b = entry.select([F.col(c).alias(f"b_{c}") for c in entry.columns])
    smaller_first = (F.col("b_size") < F.col("a_size")) | (
        (F.col("b_size") == F.col("a_size")) & (F.col("b_k") < F.col("a_k"))
    )
    fits = F.col("b_size") >= F.col("a_size") * F.lit(least) - 1e-9
    possible = F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos"))
    needed = (F.col("a_size") + F.col("b_size")) * F.lit(least / (1 + least)) - 1e-6
    first = (F.col("a_before") != F.col("b_before")) | (F.least("a_pos", "b_pos") < SHARED)
    same = F.col("a_t") == F.col("b_t")
    met = a.join(b, same & smaller_first & fits & (possible + (SHARED - 1) >= needed) & first)
    return met.groupBy("a_k", "b_k").agg(F.count(F.lit(1)).alias("times"), F.min(needed).alias("needed"))


def orders(count: int) -> list[tuple[int, int]]:
    """``(a, b)`` of as many orders of the bits, the same in every run."""
    words = [hashlib.md5(f"order|{i}".encode()).digest() for i in range(count)]
    return [
        (int.from_bytes(w[:8], "little") % (PRIME - 1) + 1, int.from_bytes(w[8:], "little") % PRIME)
        for w in words
    ]


def table_count(least: float, recall: float, per_table: int) -> int:
    """Tables after which a pair at ``least`` has been met with probability ``recall``."""
    if not 0.0 < least <= 1.0 or not 0.0 < recall < 1.0 or per_table < 1:
        raise ValueError("least must lie in (0, 1], recall in (0, 1), per_table from 1")
    missed = 1.0 - least**per_table
    return max(1, math.ceil(math.log(1.0 - recall) / math.log(missed))) if missed > 0 else 1


def _buckets(tables: int, per_table: int):
    numbers = orders(tables * per_table)

    def firsts(flat: np.ndarray, starts: np.ndarray, a: int, b: int) -> np.ndarray:
        # Modulo a Mersenne prime by folding; equal to the remainder after the second fold.
        dealt = flat * a + b
        dealt = (dealt & PRIME) + (dealt >> 31)
        dealt = (dealt & PRIME) + (dealt >> 31)
        dealt[dealt == PRIME] = 0
        return np.minimum.reduceat(dealt, starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten()).astype(np.int64)
            ends = np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))
            row = 0
            while row < len(ends):
                # Whole sets of about STEP_BITS bits together.
                at = int(ends[row - 1]) if row else 0
                stop = max(row + 1, int(np.searchsorted(ends, at + STEP_BITS)))
                part = flat[at : ends[stop - 1]]
                starts = np.concatenate([[0], ends[row : stop - 1] - at])
                out = np.zeros((stop - row, tables), dtype=np.uint64)
                for i, (a, b) in enumerate(numbers):
                    mixed = out[:, i // per_table]
                    if i % per_table == 0:
                        mixed += np.uint64(i + 1)
                    mixed ^= firsts(part, starts, a, b).astype(np.uint64)
                    mixed *= np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                sizes = np.diff(np.append(starts, len(part))).astype(np.int32)
                of = np.repeat(np.arange(row, stop), tables)
                columns = [batch.column(0).take(pa.array(of)), pa.array(np.repeat(sizes, tables)), pa.array(out.ravel().view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "size", "bucket"])
                row = stop

    return run


def sampled_index(sets: DataFrame, bits: str, tables: int, per_table: int) -> DataFrame:
    """``(k, size, bucket)``: every non-empty set's place in each table of sampled bits.

    A table samples ``per_table`` bits of a set, each the first of the set's bits in an order of
    its own. Two sets have the same sample in one order with a probability equal to their
    similarity, and so the same bucket of a table with that probability to the ``per_table``.
    Made without a shuffle; ``tables`` rows a set, whatever its size. Arrow batches, since a
    minimum over an array per order is no generated code in Spark. Null bits are left out.
    """
    whole = sets.select("k", F.array_compact(bits).alias("bits")).filter(F.size("bits") > 0)
    kind = sets.schema["k"].dataType.simpleString()
    return whole.mapInArrow(_buckets(tables, per_table), f"k {kind}, size int, bucket bigint")


def similar_pairs_sampled(
    df: DataFrame, key: str, bits: str, least: float, recall: float = 0.99, per_table: int = 3, sets: DataFrame | None = None
) -> DataFrame:
    """Pairs as in ``similar_pairs``, found through an index of sampled bits.

    Similarities are exact and no pair below ``least`` is returned; a pair at ``least`` is missed
    with a probability of about ``1 - recall``, a more similar one more rarely. An index row is
    made per set and table, where the exact join makes rows in proportion to the sets' sizes, so
    this is the form for long sets and for narrow fingerprints without rare bits. More bits to a
    table keep unlike sets apart in larger tables, at the cost of more tables.

    Copies are folded first. Null and empty sets are in no pair. ``sets`` is what ``fold_sets``
    returned, where it is there already.
    """
    tables = table_count(least, recall, per_table)
    sets = fold_sets(df, key, bits) if sets is None else sets
    # Written once: both sides of the join read it.
    index = materialize(sampled_index(sets, bits, tables, per_table), "sampled")
    a = index.select(F.col("k").alias("a_k"), F.col("size").alias("a_size"), "bucket")
    b = index.select(F.col("k").alias("b_k"), F.col("size").alias("b_size"), "bucket")
    smaller = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * F.lit(least) - 1e-9
    met = a.join(b, "bucket").filter((F.col("a_k") < F.col("b_k")) & smaller)
    return _checked(met.select("a_k", "b_k"), sets, bits, least)


def recall_by_similarity(exact: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Pairs, found pairs and their share per tenth of similarity, and for all (null tenth).

    Takes the results of ``similar_pairs`` and ``similar_pairs_sampled``.
    """
    tenth = F.floor(F.col("tanimoto") * 10 + 1e-9).cast("int")
    # Pairs take a few bytes in files and some hundred in a hash table, so they meet by shuffle.
    both = exact.select("a", "b", tenth.alias("tenth")).join(
        found.select("a", "b", F.lit(1).alias("_met")).hint("merge"), ["a", "b"], "left"
    )
    out = both.rollup("tenth").agg(F.count(F.lit(1)).alias("pairs"), F.count("_met").alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("pairs")).withColumn("least", F.lit(least))
