"""Removal of repeated (features, label) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import materialize

#: How values are written to be compared: with nulls, timestamps to the microsecond.
JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def remove_duplicates(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Keep the row with the smallest key among rows that agree in ``cols``; nulls agree.

    Only digests and keys are grouped and joined; the rows pass an anti-join against the keys of
    the copies, which are few. Rows without a key stay.
    """
    # JSON keeps apart what plain text would not: nulls, arrays, separators within values. By
    # default its timestamps would stop at milliseconds.
    named = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    digests = df.select(F.unhex(F.md5(F.to_json(named, JSON))).alias("_d"), F.col(key).alias("_k"))
    digests = materialize(digests, "digests")
    first = digests.groupBy("_d").agg(F.min("_k").alias("_first"), F.count("_k").alias("_n"))
    copies = digests.join(first.filter("_n > 1"), "_d").filter("_k <> _first").select(F.col("_k").alias(key))
    return df.join(copies, key, "left_anti")


def prepare_task(df: DataFrame, key: str, features: list[str], label: str) -> DataFrame:
    """Rows with a label, repeated (features, label) pairs removed."""
    labelled = df.filter(F.col(label).isNotNull())
    return remove_duplicates(labelled, key, [*features, label])
