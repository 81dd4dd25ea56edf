"""Intermediate tables of corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import materialize_freed as materialize
from sievework.session import shuffles_freed

__all__ = ["all_columns", "materialize", "shuffles_freed"]


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` whatever their names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
