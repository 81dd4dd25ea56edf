"""Joins of identifier, feature, label and split tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_renamed(left: DataFrame, right: DataFrame, on: str, renames: dict[str, str]) -> DataFrame:
    """Inner join on one column, columns of ``right`` renamed first."""
    return left.join(right.select(on, *[F.col(c).alias(n) for c, n in renames.items()]), on)


def keep_listed(df: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    """Rows whose key occurs in ``listed``.

    Repeated keys are folded before the shuffle, which serves the join as well.
    """
    return df.join(listed.select(on).distinct(), on, "left_semi")


def keep_unlisted(df: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    """Rows whose key does not occur in ``listed``."""
    return df.join(listed.select(on).distinct(), on, "left_anti")


def align(df: DataFrame, extra: DataFrame, on: str) -> DataFrame:
    """Attach columns of ``extra`` by key; rows without a match keep nulls."""
    return df.join(extra, on, "left")


def predetermined_split(
    df: DataFrame, folds: DataFrame, on: str, test_fold: int, val_fold: int | None = None
) -> DataFrame:
    """Tag rows from a table ``(on, fold)``: one fold is test, one may be validation."""
    tag = F.when(F.col("fold") == test_fold, "test")
    if val_fold is not None:
        tag = tag.when(F.col("fold") == val_fold, "val")
    return df.join(folds.select(on, "fold"), on).withColumn("split", tag.otherwise("train"))
