"""Projections, filters, reshaping, sorting and top-k on screening tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.hashing import order_hash
from sievework.operators.ranking import running_totals

# The columns that are never targets, and the known target names.
NOT_TARGETS = ["cid", "id", "smiles", "inchi", "toxid", "key", "fp", "fpcompressed"]
KNOWN_TARGETS = ["AR", "ER", "ED", "TR", "GR", "PPARg", "Aromatase"]
# Spellings of yes and no.
TRUE_WORDS = ["yes", "true", "t", "y", "1"]
FALSE_WORDS = ["no", "false", "f", "n", "0"]


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """All columns except ``cols``; names that are not there are ignored."""
    return df.drop(*cols)


def target_columns(
    df: DataFrame, exclude: list[str] | None = None, known: list[str] | None = None
) -> list[str]:
    """Target names: everything not excluded, or those in a list of known names."""
    if known is not None:
        return [c for c in df.columns if c in known]
    skip = NOT_TARGETS if exclude is None else exclude
    return [c for c in df.columns if c not in skip]


def valid_rows(df: DataFrame, target: str, feature: str) -> DataFrame:
    """Rows that have both the target and the feature."""
    return df.filter(F.col(target).isNotNull() & F.col(feature).isNotNull())


def complete_cases(df: DataFrame, targets: list[str]) -> DataFrame:
    """Rows that have every target."""
    return df.dropna(how="any", subset=targets)


def choose_feature(df: DataFrame, key: str, raw: str, compressed: str, use_compressed: bool) -> DataFrame:
    """Key and the wanted feature column, rows without it dropped (possibly all)."""
    col = compressed if use_compressed else raw
    return df.select(key, F.col(col).alias("feature")).filter(F.col("feature").isNotNull())


def task_rows(df: DataFrame, key: str, feature: str, target: str) -> DataFrame:
    """Key, feature and one target, rows with a missing target dropped."""
    return df.select(key, feature, target).dropna(subset=[target])


def null_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row count and number of nulls per column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
    )


def keep_members(df: DataFrame, key: str, members: list | DataFrame) -> DataFrame:
    """Rows whose key is in a short list or in the first column of a table."""
    if isinstance(members, list):
        return df.filter(F.col(key).isin(members))
    other = members.select(F.col(members.columns[0]).alias(key)).distinct()
    return df.join(other, key, "left_semi")


def to_boolean(col: Column, strict: bool = False) -> Column:
    """Yes/no text as boolean; other text raises when ``strict``, else gives null."""
    low = F.lower(col)
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), col)).cast("boolean")
    return (
        F.when(low.isin(TRUE_WORDS), F.lit(True))
        .when(low.isin(FALSE_WORDS), F.lit(False))
        .when(col.isNotNull(), bad if strict else F.lit(None).cast("boolean"))
    )


def select_columns(
    df: DataFrame,
    include: list[str] | None = None,
    ignore: list[str] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Column choice and the optional row cap a caller may ask for."""
    out = df.select(*include) if include else df
    out = out.drop(*(ignore or []))
    return out if max_rows is None else out.limit(max_rows)


def split_xy(df: DataFrame, key: str, feature: str) -> tuple[DataFrame, DataFrame]:
    """Features in long form ``(key, pos, x)`` and the remaining columns as labels."""
    x = df.select(key, F.posexplode(feature).alias("pos", "x"))
    return x, df.drop(feature)


# Reshaping


def gather(df: DataFrame, key: str, value: str, cols: list[str]) -> DataFrame:
    """Wide to long; nulls are kept."""
    ids = [c for c in df.columns if c not in cols]
    return df.unpivot(ids, cols, key, value)


def stack_tagged(parts: dict[str, DataFrame], tag: str = "set") -> DataFrame:
    """Rows of several tables one after another, with the part's name in ``tag``."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def distinct_counts(df: DataFrame, col: str | Column) -> DataFrame:
    """Distinct values with their counts."""
    value = F.col(col) if isinstance(col, str) else col
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


# Order


def sort_by_value(df: DataFrame, value: str, key: str, bias: str) -> DataFrame:
    """Largest first for ``big``, smallest first for ``small``; ties in key order."""
    if bias not in ("big", "small"):
        raise ValueError(f"bias must be 'big' or 'small', not {bias!r}")
    first = F.col(value).desc() if bias == "big" else F.col(value).asc()
    return df.orderBy(first, F.col(key))


def largest_groups(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k largest groups, ties in key order."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    return sizes.orderBy(F.col("size").desc(), F.col(key)).limit(k)


def shuffle_rows(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Repeatable random order; rows with any null are dropped."""
    return df.dropna(how="any").orderBy(order_hash(F.col(key), seed), F.col(key))


def reindex(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """Dense numbering 0, 1, 2, ... in key order."""
    ranked = running_totals(df, {name: F.lit(1)}, key)
    return ranked.withColumn(name, (F.col(name) - 1).cast("bigint"))


def best_fold(scores: DataFrame, by: list[str], keys: list[str], fold: str = "fold") -> DataFrame:
    """Per key the fold with the largest ``by`` columns; the first fold wins a tie."""
    rank = F.struct(*[F.col(c) for c in by], -F.col(fold))
    return scores.groupBy(*keys).agg(
        F.max_by(F.col(fold), rank).alias("best_fold"),
        *[F.max_by(F.col(c), rank).alias(c) for c in by],
    )
