"""Global order without a global sort.

Three tools, all built on the same idea: cut the order into buckets that no single value
can fill, aggregate per bucket, and add up the small bucket table.

* ``running_totals`` gives every row its running sum (or rank).
* ``thresholds`` finds the rows at which given quotas are reached, so that taking the
  first k rows of an order needs no shuffle of the rows at all.
* ``spread_join`` joins rows to a table of their groups when some groups are huge.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from sievework.functions.hashing import order_hash
from sievework.session import materialize

# Up to so many strata are looked up in a list by every row, more are joined.
FEW_STRATA = 64
# Columns that quantiles can cut.
ORDERED_TYPES = (NumericType, TimestampType, TimestampNTZType, DateType, StringType)
# Rows looked at per bucket to place the bounds of text; bounds only balance the buckets.
TEXT_SAMPLE = 20


def bucket_count(df: DataFrame) -> int:
    """Buckets per order: a few per shuffle partition, and never so many that the
    boundary list (kept on the driver) becomes large."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, min(4 * partitions, 8192))


def _sortable(df: DataFrame, column: str) -> Column:
    """Text as it is; numbers, timestamps and dates as a number that grows with the column."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, StringType):
        return c
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, TimestampNTZType):
        # By parts: a cast through the session time zone would not grow across a clock change.
        day = F.unix_date(c.cast("date")).cast("double") * 86400
        time = F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")
        return day + time
    return c.cast("double")


def _boundaries(df: DataFrame, column: Column, text: bool, n: int, spread: Column) -> list:
    """Up to ``n - 1`` quantiles in order; a value that fills several is there several times.

    Those of text are taken of the ``TEXT_SAMPLE * n`` rows with the least digests.
    """
    if text:
        digest = F.xxhash64(column, spread)
        rows = df.filter(column.isNotNull()).select(column.alias("v"), digest.alias("h"))
        found = sorted((r["v"] for r in rows.orderBy("h").limit(TEXT_SAMPLE * n).collect()), key=str.encode)
        return [found[i * len(found) // n] for i in range(1, n)] if found else []
    probs = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(column, probs, max(10_000, 10 * n))).first()
    return [b for b in (row[0] or []) if b is not None and not math.isnan(b)]


def _after(bound: float | str) -> float | str:
    """The least value above a bound."""
    return bound + "\0" if isinstance(bound, str) else math.nextafter(bound, math.inf)


def _bucketize(df: DataFrame, column: Column, text: bool, bounds: list, name: str) -> DataFrame:
    """Add the number of bounds that are not above the column; one more than all for nulls."""
    if text:
        bounds = sorted(set(bounds), key=str.encode)
        if not bounds:
            return df.withColumn(name, column.isNull().cast("double"))
        # First the block of bounds, then the place in it.
        wide = math.isqrt(len(bounds)) + 1
        blocks = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
        upto = lambda values: F.size(F.filter(values, lambda x: x <= column))
        block = upto(F.lit([x[0] for x in blocks])) - 1
        lists = F.lit([x + x[-1:] * (wide - len(x)) for x in blocks])
        inside = F.least(upto(F.get(lists, block)), F.lit(len(bounds)) - block * wide)
        place = F.when(column.isNull(), len(bounds) + 1).when(block < 0, 0).otherwise(block * wide + inside)
        return df.withColumn(name, place.cast("double"))
    splits = [-math.inf, *sorted(set(bounds) - {-math.inf, math.inf}), math.inf]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0.0))
    raw = f"{name}_raw"
    sliced = Bucketizer(splits=splits, inputCol=raw, outputCol=name, handleInvalid="keep")
    return sliced.transform(df.withColumn(raw, column)).drop(raw)


def value_buckets(
    df: DataFrame, value: str, tie: str | None = None, name: str = "_b", n: int | None = None
) -> DataFrame:
    """Add a bucket number that grows with ``(value, tie)``.

    Boundaries are quantiles (one aggregation, at most ``n`` numbers). A value that fills
    several quantiles gets a bucket of its own, which is cut again by quantiles of ``tie``
    into as many pieces as it filled: a value held by a third of all rows is spread like any
    other. There are at most ``2 n`` buckets. Numbers, timestamps, dates and text.
    """
    n = n or bucket_count(df)
    is_text = lambda column: isinstance(df.schema[column].dataType, StringType)
    spread = F.col(tie or value)
    number, text = _sortable(df, value), is_text(value)
    bounds = _boundaries(df, number, text, n, spread)
    repeats = {b: k for b, k in Counter(bounds).items() if k > 1}
    splits = sorted(set(bounds) | {_after(b) for b in repeats}, key=str.encode if text else None)
    df = _bucketize(df, number, text, splits, "_vb")
    if not repeats or tie is None or not isinstance(df.schema[tie].dataType, ORDERED_TYPES):
        return df.withColumn(name, F.col("_vb").cast("bigint") * F.lit(n)).drop("_vb")
    # Bucket i + 1 starts at splits[i]; "keep" adds one more for nulls.
    pieces = F.lit([0, *[repeats.get(b, 0) for b in splits], 0])
    df = df.withColumn("_p", F.element_at(pieces, F.col("_vb").cast("int") + 1))
    tie_number, text = _sortable(df, tie), is_text(tie)
    tie_bounds = _boundaries(df.filter(F.col("_p") > 0), tie_number, text, n, spread)
    hot_tie = F.when(F.col("_p") > 0, tie_number)
    df = _bucketize(df, hot_tie, text, tie_bounds, "_tb")
    sub = F.when(F.col("_p") > 0, F.floor(F.col("_tb") * F.col("_p") / F.lit(n + 2))).otherwise(0)
    bucket = F.col("_vb").cast("bigint") * F.lit(n) + sub.cast("bigint")
    return df.withColumn(name, bucket).drop("_vb", "_tb", "_p")


def running_totals(
    df: DataFrame,
    totals: dict[str, Column],
    value: str,
    tie: str | None = None,
    partition: list[str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums in the order ``(value, tie)``, per ``partition``.

    ``totals={"rank": F.lit(1)}`` gives a dense row number. The rows are shuffled once, on
    (partition, bucket); no task gets more than one bucket of one partition.
    """
    keys = [*(partition or []), "_b"]
    work = value_buckets(df, value, tie)
    for name, expr in totals.items():
        work = work.withColumn(f"_x_{name}", expr)
    sums = work.groupBy(*keys).agg(
        *[F.sum(f"_x_{name}").alias(f"_s_{name}") for name in totals]
    )
    by_bucket = F.col("_b").desc() if descending else F.col("_b").asc()
    before = (
        Window.partitionBy(*[F.col(c) for c in (partition or [])] or [F.lit(0)])
        .orderBy(by_bucket)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0)
    offsets = sums.select(
        *[F.col(c).alias(f"_at_{c}") for c in keys],
        *[F.coalesce(F.sum(f"_s_{n}").over(before), zero).alias(f"_o_{n}") for n in totals],
    )
    if not partition:
        # One row per bucket: value_buckets makes at most 2 * bucket_count() of them.
        offsets = F.broadcast(offsets)
    order = [c for c in (value, tie) if c]
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # The null partition is one like any other.
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in keys])
    return work.join(offsets, same).select(
        *df.columns,
        *[(F.sum(f"_x_{n}").over(inside) + F.col(f"_o_{n}")).alias(n) for n in totals],
    )


def hash_order(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Add ``_o``, the pseudo-random place of a row, and its bucket ``_b``.

    Digests are spread evenly, so their first four digits make 65,536 equal buckets.
    """
    return df.withColumn("_h", order_hash(F.col(key), seed)).select(
        "*",
        F.struct(F.col("_h").alias("h"), F.col(key).alias("k")).alias("_o"),
        F.substring("_h", 1, 4).alias("_b"),
    ).drop("_h")


def value_order(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Add ``_o`` and ``_b`` for the order ``(value, tie)``."""
    return value_buckets(df, value, tie).withColumn(
        "_o", F.struct(F.col(value).alias("h"), F.col(tie).alias("k"))
    )


def _histogram(work: DataFrame) -> DataFrame:
    """(_s, _b, c, n, upto): rows per bucket, per stratum, and up to the bucket's end."""
    of_stratum = Window.partitionBy("_s")
    return (
        work.groupBy("_s", "_b")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("n", F.sum("c").over(of_stratum))
        .withColumn("upto", F.sum("c").over(of_stratum.orderBy("_b")))
    )


def _edges(hist: DataFrame) -> DataFrame:
    """(_s, _b, n, needs): the buckets in which a cut falls, and its row there."""
    need = F.least("cut", "n") - F.col("upto") + F.col("c")
    return (
        hist.select("*", F.posexplode("cuts").alias("i", "cut"))
        .withColumn("need", need)
        .filter((F.col("need") > 0) & (F.col("need") <= F.col("c")))
        .groupBy("_s", "_b")
        .agg(F.max("n").alias("n"), F.collect_list(F.struct("i", "need")).alias("needs"))
    )


def _found(work: DataFrame, edges: DataFrame) -> DataFrame:
    """(_s, n, at): the order position of every cut of a stratum."""
    return (
        work.join(edges, ["_s", "_b"])
        .withColumn("rn", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_o")))
        .select("_s", "n", "_o", "rn", F.explode("needs").alias("need"))
        .filter(F.col("rn") == F.col("need.need"))
        .groupBy("_s")
        .agg(
            F.max("n").alias("n"),
            F.map_from_entries(F.collect_list(F.struct("need.i", "_o"))).alias("at"),
        )
    )


def thresholds(
    ordered: DataFrame,
    cuts: Callable[[DataFrame], DataFrame],
    n_cuts: int,
    stratum: Column | None = None,
) -> list[Column]:
    """The order positions at which running row counts reach given quotas.

    ``ordered`` has ``_o`` and ``_b``. ``cuts`` gets the histogram ``(_s, _b, c, n)``, where
    ``n`` is the size of the stratum ``_s``, and adds ``cuts``: an array of ``n_cuts``
    cumulative row counts per stratum. Returns one column per cut, to be used on a frame with
    the same stratum expression: a row lies before the cut when ``_o <= column``; the column
    is null when the cut is empty.

    Cost: one aggregation to a histogram, one ranking of the few buckets in which a cut
    falls, and a scalar subquery. The rows themselves are not moved. Every row looks its
    stratum up in a map, so this is for strata that are few by how they are made;
    ``segments`` takes any number.
    """
    stratum = F.lit(0) if stratum is None else stratum
    work = ordered.select(stratum.alias("_s"), "_b", "_o").filter(F.col("_s").isNotNull())
    # At most n_cuts buckets per stratum.
    found = _found(work, F.broadcast(_edges(cuts(_histogram(work)))))
    return _places(_of_stratum(found, stratum), n_cuts)


def _of_stratum(found: DataFrame, stratum: Column) -> Column:
    lookup = found.agg(F.map_from_entries(F.collect_list(F.struct("_s", "at")))).scalar()
    return F.try_element_at(lookup, stratum)


def _places(at: Column, n_cuts: int) -> list[Column]:
    return [F.try_element_at(at, F.lit(i)) for i in range(n_cuts)]


def segments(
    ordered: DataFrame,
    cuts: Callable[[DataFrame], DataFrame],
    n_cuts: int,
    stratum: str,
    key: str,
    name: str,
) -> DataFrame:
    """Add ``name``, the index of the segment a row of its stratum falls in, see ``thresholds``.

    For any number of strata: histogram, edges and cuts are tables in the shared folder. Rows
    find the cuts of a few strata in a list, without a join. Those of many strata meet them
    in ``spread_join``: while the table of cuts is small Spark broadcasts it, beyond that only
    rows of strata with less than a thousandth of all rows are shuffled by stratum. The
    result is the same either way.
    """
    work = ordered.select(F.col(stratum).alias("_s"), "_b", "_o").filter(F.col("_s").isNotNull())
    hist = materialize(_histogram(work), "histogram")
    found = materialize(_found(work, materialize(_edges(cuts(hist)), "edges")), "cuts")
    if found.limit(FEW_STRATA + 1).count() <= FEW_STRATA:
        index = segment(_places(_of_stratum(found, F.col(stratum)), n_cuts))
        return ordered.withColumn(name, index).drop("_o", "_b")
    at = found.select(F.col("_s").alias(stratum), F.col("n").alias("_n"), F.col("at").alias("_at"))
    placed = spread_join(ordered, at, stratum, key, "_n", ["_at"])
    return placed.withColumn(name, segment(_places(F.col("_at"), n_cuts))).drop("_at", "_o", "_b")


def segment(at: list[Column]) -> Column:
    """Index of the segment a row falls in: 0 before the first cut, 1 before the next, ..."""
    label = F.lit(len(at))
    for i in reversed(range(len(at))):
        label = F.when(F.col("_o") <= at[i], F.lit(i)).otherwise(label)
    return label


def spread_join(
    rows: DataFrame, groups: DataFrame, key: str, row_id: str, size: str, cols: list[str]
) -> DataFrame:
    """Add group columns to rows when a group may hold any share of the rows.

    ``size`` is the number of rows of a group, so fewer than 1,000 groups can hold more than
    a thousandth of the rows each: those are broadcast, and their rows take no part in the
    shuffle join except under a salted key that matches nothing.
    """
    total = groups.agg(F.sum(size)).scalar()
    hot = groups.filter(F.col(size) * F.lit(1000) > total).select(
        F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in cols]
    )
    plain = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))
    cold = groups.select(
        plain.alias("_jk"),
        *[F.col(c).alias(f"_c_{c}") for c in cols],
    )
    salt = F.concat(F.lit("s"), F.pmod(F.xxhash64(row_id), F.lit(4096)).cast("string"))
    joined = (
        rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hk")), "left")
        .withColumn("_jk", F.when(F.col("_hk").isNotNull(), salt).otherwise(plain))
        .join(cold, "_jk", "left")
    )
    return joined.select(
        *rows.columns,
        *[F.when(F.col("_hk").isNotNull(), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c)
          for c in cols],
    )
