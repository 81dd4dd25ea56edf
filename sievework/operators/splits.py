"""Splits and samples that every engine and every cluster size reproduces.

Row order is a seeded digest of the key, so a split is a property of the data alone. Random,
stratified and fold splits compare each row with a few thresholds and never move the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.ranking import (
    hash_order,
    running_totals,
    segment,
    segments,
    spread_join,
    thresholds,
    value_order,
)
from sievework.session import materialize

# Fixed value: a class smaller than this share of the other is called imbalanced.
ALLOWED_IMBALANCE = 0.1


def _check_sizes(sizes: tuple[float, float, float]) -> None:
    if len(sizes) != 3 or abs(sum(sizes) - 1) > 1e-8 or min(sizes) < 0:
        raise ValueError(f"train, val and test shares must add up to 1, not {sizes}")


def _named(index: Column, names: list[str]) -> Column:
    return F.element_at(F.lit(names), index + 1)


def _label(df: DataFrame, at: list[Column], names: list[str]) -> DataFrame:
    return df.withColumn("split", _named(segment(at), names)).drop("_o", "_b")


def _test_rows(n: Column, test_size: float) -> Column:
    return F.ceil(F.round(n * F.lit(test_size), 9)).cast("bigint")


def random_split(df: DataFrame, key: str, test_size: float, seed: int = 42) -> DataFrame:
    """Tag ``ceil(test_size * n)`` rows as test, the others as train."""
    if not 0.0 <= test_size <= 0.5:
        raise ValueError("test_size must lie in [0, 0.5]")
    ordered = hash_order(df, key, seed)
    cuts = lambda hist: hist.withColumn("cuts", F.array(_test_rows(F.col("n"), test_size)))
    return _label(ordered, thresholds(ordered, cuts, 1), ["test", "train"])


def stratified_split(
    df: DataFrame, key: str, label: str, test_size: float, seed: int = 42
) -> DataFrame:
    """The same per class; rows without a label are left out. Any number of classes."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must lie in (0, 1)")
    ordered = hash_order(df.filter(F.col(label).isNotNull()), key, seed)
    cuts = lambda hist: hist.withColumn("cuts", F.array(_test_rows(F.col("n"), test_size)))
    placed = segments(ordered, cuts, 1, label, key, "split")
    return placed.withColumn("split", _named(F.col("split"), ["test", "train"]))


def _check_folds(k: int) -> None:
    if not 1 < k < 10:
        raise ValueError("the number of folds must lie between 2 and 9")


def k_fold(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """Add ``fold`` 1..k: blocks of the random order, the first ``n % k`` one row longer."""
    _check_folds(k)
    ordered = hash_order(df, key, seed)
    n = F.col("n")
    block = F.floor(n / F.lit(k))
    ends = [block * i + F.least(F.lit(i), F.pmod(n, F.lit(k))) for i in range(1, k)]
    cuts = lambda hist: hist.withColumn("cuts", F.array(*[e.cast("bigint") for e in ends]))
    at = thresholds(ordered, cuts, k - 1)
    return ordered.withColumn("fold", segment(at) + 1).drop("_o", "_b")


def stratified_k_fold(df: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Add ``fold`` 1..k with every class spread evenly.

    With the rows laid out class after class, fold f takes as many rows of a class as there
    are places p in the class's block with ``p % k == f - 1``. So class shares differ by at
    most one row between folds, and fold sizes too. Rows without a label are left out.
    """
    _check_folds(k)
    ordered = hash_order(df.filter(F.col(label).isNotNull()), key, seed)

    def cuts(hist: DataFrame) -> DataFrame:
        # Where a class's block of places begins and ends.
        classes = hist.groupBy("_s").agg(F.max("n").alias("m"))
        upto = running_totals(classes, {"b": F.col("m")}, "_s").select("_s", "b")
        b = F.col("b")
        a = b - F.col("n")
        below = lambda x, f: F.floor((x - F.lit(f) + F.lit(k - 1)) / F.lit(k))
        takes = [below(b, f) - below(a, f) for f in range(k)]
        ends = [sum(takes[1 : f + 1], takes[0]).cast("bigint") for f in range(k - 1)]
        return hist.join(upto, "_s").withColumn("cuts", F.array(*ends)).drop("b")

    placed = segments(ordered, cuts, k - 1, label, key, "fold")
    return placed.withColumn("fold", F.col("fold") + 1)


def weight_split(
    df: DataFrame, key: str, weight: str, sizes: tuple[float, float, float], bias: str = "small"
) -> DataFrame:
    """Train takes the first ``int(train * n)`` rows by weight, val the next, test the rest.

    ``small`` puts light rows into train, ``big`` heavy ones. Rows without a weight are left
    out after the shares have been computed, so they shorten the test part.
    """
    _check_sizes(sizes)
    if bias not in ("big", "small"):
        raise ValueError(f"bias must be 'big' or 'small', not {bias!r}")
    # Shares are taken of all rows; the null rows come off the end.
    total = df.agg(F.count(F.lit(1))).scalar()
    sign = -1 if bias == "big" else 1
    rows = df.filter(F.col(weight).isNotNull()).withColumn("_w", F.col(weight) * F.lit(sign))
    ordered = value_order(rows, "_w", key)
    whole = lambda share: F.floor(F.round(total * F.lit(share), 9)).cast("bigint")
    ends = F.array(whole(sizes[0]), whole(sizes[0] + sizes[1]))
    at = thresholds(ordered, lambda hist: hist.withColumn("cuts", ends), 2)
    return _label(ordered, at, ["train", "val", "test"]).drop("_w")


def down_sample(
    df: DataFrame, key: str, label: str, fraction: float, seed: int = 42
) -> DataFrame:
    """All ones and ``int(min(n0, n1 / fraction))`` zeros."""
    if fraction <= 0:
        raise ValueError("fraction must be positive")
    rows = df.filter(F.col(label).isin(0, 1))
    ones = rows.agg(F.count_if(F.col(label) == 1)).scalar()
    ordered = hash_order(rows, key, seed)
    quota = F.floor(F.round(ones / F.lit(fraction), 9)).cast("bigint")
    cuts = lambda hist: hist.withColumn(
        "cuts", F.array(F.when(F.col("_s") == 1, F.col("n")).otherwise(quota))
    )
    at = thresholds(ordered, cuts, 1, F.col(label))
    return ordered.filter(F.col("_o") <= at[0]).drop("_o", "_b")


def prepare_target(
    df: DataFrame, key: str, label: str, fraction: float | None, seed: int = 42
) -> DataFrame:
    """Down-sample as asked; a badly imbalanced target is sampled at 0.1 instead.

    Only this target is affected. ``fraction=None`` turns sampling off.
    """
    rows = df.filter(F.col(label).isNotNull())
    if fraction is None:
        return rows
    counts = rows.agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    ).first()
    small, large = sorted([counts["n0"], counts["n1"]])
    return down_sample(
        rows, key, label, ALLOWED_IMBALANCE if small < large * ALLOWED_IMBALANCE else fraction, seed
    )


def proportional_sample(
    df: DataFrame, key: str, split: str, n: int = 1000, first: str = "train", seed: int = 42
) -> DataFrame:
    """``n`` rows shared between two parts by their sizes: ``int(n * share)`` for ``first``.

    The second part is every row with another value; rows without one are left out.
    """
    ordered = hash_order(df, key, seed)
    total = df.agg(F.count(F.lit(1))).scalar()
    of_first = df.agg(F.count_if(F.col(split) == first)).scalar()
    quota = F.floor(of_first * F.lit(n) / total).cast("bigint")
    want = F.when(F.col("_s"), quota).otherwise(F.lit(n) - quota)
    cuts = lambda hist: hist.withColumn("cuts", F.array(want))
    at = thresholds(ordered, cuts, 1, F.col(split) == first)
    return ordered.filter(F.col("_o") <= at[0]).drop("_o", "_b")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight`` so that both classes weigh the same in total."""
    rows = df.filter(F.col(label).isNotNull())
    n = rows.agg(
        F.struct(
            F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
        )
    ).scalar()
    total = n.getField("n0") + n.getField("n1")
    own = F.when(F.col(label) == 1, n.getField("n1")).otherwise(n.getField("n0"))
    return rows.withColumn("weight", total / (2.0 * own))


# Group splits


def group_sizes(df: DataFrame, group: str, key: str) -> DataFrame:
    """One row per group: its size and its first key. Kept in the shared folder, because
    every group split reads it several times."""
    sizes = df.groupBy(group).agg(
        F.count(F.lit(1)).cast("bigint").alias("size"), F.min(key).alias("first")
    )
    return materialize(sizes, "groups")


def size_quotas(hist: DataFrame, sizes: tuple[float, float, float]) -> DataFrame:
    """How many groups of each size go to test and to train when groups are placed from
    the largest to the smallest.

    Groups of one size are interchangeable, so the fill needs one step per distinct size.
    N rows have at most sqrt(2 N) distinct group sizes, so this table stays small whatever
    the data is: a few MB for 10^12 rows.
    """
    train_share, _, test_share = sizes

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        table = pd.concat(parts).sort_values("size", ascending=False, ignore_index=True)
        total = int((table["size"] * table["m"]).sum())
        test_room, train_room = test_share * total + 1e-9, train_share * total + 1e-9
        to_test, to_train = [], []
        for size, m in zip(table["size"].tolist(), table["m"].tolist()):
            t = min(m, int(test_room // size))
            r = min(m - t, int(train_room // size))
            test_room -= t * size
            train_room -= r * size
            to_test.append(t)
            to_train.append(r)
        yield table.assign(n_test=to_test, n_train=to_train)

    return hist.repartition(1).mapInPandas(
        fill, "size bigint, m bigint, n_test bigint, n_train bigint"
    )


def group_split(
    df: DataFrame, group: str, key: str, sizes: tuple[float, float, float] = (0.8, 0.0, 0.2)
) -> DataFrame:
    """Split by group, largest group first: into test if it fits, else train, else val.

    No group is in two splits. Equal sizes are placed in order of their first key.
    """
    _check_sizes(sizes)
    groups = group_sizes(df, group, key)
    hist = groups.groupBy("size").agg(F.count(F.lit(1)).cast("bigint").alias("m"))
    quotas = materialize(size_quotas(hist, sizes), "quotas")
    # At most sqrt(2 N) rows, see size_quotas.
    placed = groups.join(F.broadcast(quotas), "size")
    left = F.col("m") - F.col("n_test")
    # Sizes whose groups are divided between splits. Each such step more than halves the
    # room it fills, so there are at most 2 log2(N) of them.
    divided = ((F.col("n_test") > 0) & (left > 0)) | ((F.col("n_train") > 0) & (F.col("n_train") < left))
    ordered = value_order(placed.filter(divided), "first", group)
    ends = F.array(F.col("n_test"), F.col("n_test") + F.col("n_train"))
    cuts = lambda hist: hist.join(
        F.broadcast(quotas.select(F.col("size").alias("_s"), ends.alias("cuts"))), "_s"
    )
    at = thresholds(ordered, cuts, 2, F.col("size"))
    placed = placed.withColumn("_o", F.struct(F.col("first").alias("h"), F.col(group).alias("k")))
    split = (
        F.when(divided, F.element_at(F.lit(["test", "train", "val"]), segment(at) + 1))
        .when(F.col("n_test") > 0, "test")
        .when(F.col("n_train") > 0, "train")
        .otherwise("val")
    )
    placed = placed.withColumn("split", split).select(group, "size", "split")
    return spread_join(df, placed, group, key, "size", ["split"])


def _fill_in_order(
    groups: DataFrame, seeds: list[int], room: dict[int, float], taken: Column
) -> dict[int, list[tuple[str, float]]]:
    """Greedy fill in a fixed order: take a group if it fits into the room that is left.

    Only a few groups are ever refused while room remains: each step below finds, for all
    seeds in one job, the first group that does not fit; everything before it is taken and
    the search goes on behind it among the groups that are small enough. The result per seed
    is a list of ``(last place, largest size)`` runs.
    """
    runs: dict[int, list[tuple[str, float]]] = {s: [] for s in seeds}
    place = dict.fromkeys(seeds, "")
    open_seeds = [s for s in seeds if room[s] > 0]
    while open_seeds:
        wanted = F.lit(False)
        left = F.lit(0.0)
        for s in open_seeds:
            mine = F.col("seed") == s
            wanted = wanted | (mine & (F.col("_p") > place[s]) & (F.col("size") <= room[s]))
            left = F.when(mine, F.lit(room[s])).otherwise(left)
        rest = groups.filter(wanted & ~taken).withColumn("_room", left)
        found = {r["seed"]: r for r in _first_refused(rest).collect()}
        still = []
        for s in open_seeds:
            if s not in found:
                runs[s].append(("~", room[s]))
                continue
            runs[s].append((found[s]["place"], room[s]))
            place[s] = found[s]["place"]
            room[s] -= found[s]["used"]
            if room[s] >= 1:
                still.append(s)
        open_seeds = still
    return runs


def _first_refused(rest: DataFrame) -> DataFrame:
    """Per seed the first group at which the running size exceeds the room: one row each."""
    sums = rest.groupBy("seed", "_b", "_room").agg(F.sum("size").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("seed").orderBy("_b"))
    edge = (
        sums.withColumn("upto", upto)
        .filter((F.col("upto") > F.col("_room")) & (F.col("upto") - F.col("c") <= F.col("_room")))
        .select("seed", "_b", (F.col("upto") - F.col("c")).alias("used0"))
    )
    in_order = Window.partitionBy("seed", "_b").orderBy("_p")
    # One edge bucket per seed.
    ranked = (
        rest.join(F.broadcast(edge), ["seed", "_b"])
        .withColumn("used", F.col("used0") + F.sum("size").over(in_order) - F.col("size"))
        .filter(F.col("used") + F.col("size") > F.col("_room"))
    )
    first = ranked.groupBy("seed").agg(F.min_by(F.struct("_p", "used"), "_p").alias("f"))
    return first.select("seed", F.col("f._p").alias("place"), F.col("f.used").alias("used"))


def _in_runs(runs: dict[int, list[tuple[str, float]]]) -> Column:
    hit = F.lit(False)
    for s, parts in runs.items():
        start = ""
        for end, largest in parts:
            inside = (F.col("_p") >= start) & (F.col("_p") < end) & (F.col("size") <= largest)
            hit = hit | ((F.col("seed") == s) & inside)
            start = end
    return hit


def repeated_group_folds(
    df: DataFrame,
    group: str,
    key: str,
    seeds: list[int],
    sizes: tuple[float, float, float] = (0.8, 0.0, 0.2),
) -> DataFrame:
    """Balanced group splits for several seeds: rows ``(..., seed, split)``."""
    placed = group_folds(df, group, key, seeds, sizes)
    return placed.select(*df.columns, F.explode("folds").alias("_f")).select(
        *df.columns, "_f.seed", "_f.split"
    )


def group_folds(
    df: DataFrame,
    group: str,
    key: str,
    seeds: list[int],
    sizes: tuple[float, float, float] = (0.8, 0.0, 0.2),
) -> DataFrame:
    """Balanced group splits, one entry ``(seed, split)`` per seed in the column ``folds``.

    Big groups (more than half the val or test room) come first, then the others, each in a
    seeded random order; every group goes to test if it fits, else train, else val. With no
    val room every group is big, so the order is simply random.
    """
    _check_sizes(sizes)
    groups = group_sizes(df, group, key)
    total = groups.agg(F.sum("size")).first()[0] or 0
    train, val, test = (share * total + 1e-9 for share in sizes)
    # Without val room the half-room limit is 0, not the rounding slack above.
    is_big = (F.col("size") > (0 if sizes[1] == 0 else val / 2)) | (
        F.col("size") > (0 if sizes[2] == 0 else test / 2)
    )
    # The null group is a group like any other.
    named = F.coalesce(F.col(group).cast("string"), F.lit("\x00null"))
    h = F.md5(F.concat(F.col("seed").cast("string"), F.lit("|"), named))
    many = materialize(
        groups.withColumn("seed", F.explode(F.lit(seeds)))
        .withColumn("_p", F.concat(F.when(is_big, "0").otherwise("1"), h))
        .withColumn("_b", F.substring("_p", 1, 4)),
        "folds",
    )
    tests = _fill_in_order(many, seeds, dict.fromkeys(seeds, test), F.lit(False))
    in_test = _in_runs(tests)
    trains = _fill_in_order(many, seeds, dict.fromkeys(seeds, train), in_test)
    split = F.when(in_test, "test").when(_in_runs(trains), "train").otherwise("val")
    per_group = many.withColumn("split", split).groupBy(group).agg(
        F.max("size").alias("size"),
        F.sort_array(F.collect_list(F.struct("seed", "split"))).alias("folds"),
    )
    return spread_join(df, per_group, group, key, "size", ["folds"])


def balanced_group_split(
    df: DataFrame,
    group: str,
    key: str,
    sizes: tuple[float, float, float] = (0.8, 0.0, 0.2),
    seed: int = 0,
) -> DataFrame:
    """One balanced group split, see ``repeated_group_folds``."""
    return repeated_group_folds(df, group, key, [seed], sizes).drop("seed")
