"""Row-local operators on a stream.

These need no state and no watermark: the same expressions run on a batch table and on
``readStream``, so scoring and featurising new rows as they arrive is the batch code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet files that keep arriving in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def run_available(
    rows: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, state: str
) -> StreamingQuery:
    """Apply a row-local operator to everything that has arrived and append it to Parquet.

    ``state`` is a folder all executors reach; a rerun continues where this one ended.
    """
    return (
        operator(rows)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(target)
    )
