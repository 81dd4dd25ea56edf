"""Where shared intermediate tables live."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a finished write are removed at once, not when the driver collects garbage.

    The setting holds for the whole session, so operators that use it run in one thread.
    """
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as named by ``spark.checkpoint.dir``.

    A folder of our own is made only when the session names none and Spark runs in one
    process (tests); on a cluster a machine-local folder would be lost with its machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    path = tempfile.mkdtemp(prefix="sievework-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/sievework-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a derived table feeds several jobs. The result has no lineage, keeps column
    pruning and filter push-down, and does not depend on any executor staying alive.

    With ``by`` the table is kept in buckets of that column: what is grouped by it, or joined on
    it and other columns with a table kept alike, is not shuffled again. All rows of one value
    are in one bucket, so this is for columns without hot values.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = path.rsplit("/", 1)[1].replace("-", "_")
    # Spark leaves the repartition out where the rows lie that way already.
    placed = df.repartition(pieces, by).write.bucketBy(pieces, by)
    placed.option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def materialize_freed(df: DataFrame, name: str = "table") -> DataFrame:
    """``materialize``, giving back the space of the shuffles behind ``df``."""
    with shuffles_freed(df.sparkSession):
        return materialize(df, name)
