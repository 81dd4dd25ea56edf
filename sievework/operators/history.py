"""Analytics over training histories: rows ``(run, epoch, metric columns)``.

Epochs of a run are dense, 0, 1, 2, ...; ``number_epochs`` makes them so. A run may be
arbitrarily long: nothing here gathers more than one bounded chunk of a run in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.ranking import running_totals
from sievework.session import materialize

# Epochs handled together by early_stop.
CHUNK = 4096
# Chunks after which the end of a smoothed chunk is below the least double: 1e308 * 1e-200 ** 4 = 0.
CARRIED = 4


def number_epochs(df: DataFrame, run: str, order: str, tie: str, name: str = "epoch") -> DataFrame:
    """Dense epoch numbers from 0 per run, in the order ``(order, tie)``."""
    ranked = running_totals(df, {name: F.lit(1)}, order, tie, [run])
    return ranked.withColumn(name, (F.col(name) - 1).cast("bigint"))


def smooth(df: DataFrame, run: str, epoch: str, value: str, factor: float = 0.8) -> DataFrame:
    """Exponential moving average per run: ``s0 = p0``, ``s = factor s + (1 - factor) p``.

    The average goes over a run's values in the order of their epochs, which may have gaps.
    Null and NaN are no values: they have no average and leave the others' as they are.

    Inside a chunk of values the average is a running sum of ``p / factor ** k``, scaled back
    by ``factor ** k``; values are taken relative to the chunk's largest, so that sums stay
    finite. ``factor ** chunk`` is about 1e-200, so a chunk end has decayed to zero in
    doubles after ``CARRIED`` more chunks, and each hands itself on to so many.
    """
    if not 0.0 < factor < 1.0:
        raise ValueError("factor must lie between 0 and 1")
    chunk = math.ceil(-460 / math.log(factor))
    power = lambda k: F.pow(F.lit(factor), k)
    has = _number(F.col(value))
    plain = df.select(run, epoch, F.col(value).cast("double").alias(value))
    rows = (
        running_totals(plain, {"_i": has.cast("bigint")}, epoch, None, [run])
        .withColumn("_i", F.col("_i") - 1)
        .withColumn("_c", F.floor(F.col("_i") / F.lit(chunk)))
        .withColumn("_k", (F.col("_i") - F.col("_c") * F.lit(chunk)).cast("double"))
        .withColumn("_p", F.when(has, F.col(value) * F.when(F.col("_i") == 0, 1.0).otherwise(1.0 - factor)))
    )
    # A chunk that is not full is the last one, so nothing takes its end.
    ends = rows.groupBy(run, "_c").agg(
        F.sum(F.col("_p") * power(F.lit(chunk - 1.0) - F.col("_k"))).alias("_end")
    )
    handed = ends.select(run, "_end", F.posexplode(F.array(*[F.col("_c") + i + 1 for i in range(CARRIED)])))
    decayed = F.col("_end")
    for i in range(1, CARRIED):
        # Step by step: the power alone would already be zero.
        decayed = F.when(F.col("pos") >= i, decayed * power(F.lit(float(chunk)))).otherwise(decayed)
    before = handed.groupBy(F.col(run).alias("_run"), F.col("col").alias("_chunk")).agg(
        F.sum(decayed).alias("_before")
    )
    of_chunk = Window.partitionBy(run, "_c")
    inside = of_chunk.orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.abs(F.col("_p"))
    scale = F.max(F.when((size > 0) & (size < math.inf), size)).over(of_chunk)
    rows = rows.withColumn("_scale", F.coalesce(scale, F.lit(1.0)))
    local = F.sum(F.col("_p") / F.col("_scale") * power(-F.col("_k"))).over(inside)
    inherited = F.coalesce(F.col("_before") * power(F.col("_k") + 1), F.lit(0.0))
    smoothed = F.when(has, local * power(F.col("_k")) * F.col("_scale") + inherited)
    same = F.col(run).eqNullSafe(F.col("_run")) & (F.col("_c") == F.col("_chunk"))
    return rows.join(before, same, "left").select(run, epoch, value, smoothed.alias("smoothed"))


def best_smoothed(df: DataFrame, run: str, epoch: str, value: str, factor: float = 0.8) -> DataFrame:
    """Largest smoothed value per run."""
    return smooth(df, run, epoch, value, factor).groupBy(run).agg(F.max("smoothed").alias("best"))


def _number(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def best_epoch(df: DataFrame, run: str, epoch: str, monitor: str) -> DataFrame:
    """Per run the whole row with the smallest ``monitor``; the first epoch wins a tie.

    Null and NaN come after all numbers.
    """
    others = [c for c in df.columns if c != run]
    key = F.struct(~_number(F.col(monitor)), F.col(monitor), F.col(epoch))
    best = df.groupBy(run).agg(F.min_by(F.struct(*others), key).alias("_r"))
    return best.select(run, "_r.*")


def early_stop(
    df: DataFrame,
    run: str,
    epoch: str,
    monitor: str,
    patience: int = 20,
    min_delta: float = 0.0001,
    chunk: int = CHUNK,
) -> DataFrame:
    """Where training would have stopped, and which epoch's weights it would have kept.

    An epoch is an improvement when it is lower than the best so far by more than
    ``min_delta``; after ``patience`` epochs without one the run stops (``stop_epoch``, null
    if it never does). ``best`` and ``best_epoch`` describe the weights that are restored.

    All runs advance together, ``chunk`` epochs at a time, carrying the state of each run;
    runs that have stopped drop out. Histories up to ``chunk`` epochs take one step.
    """
    last = df.agg(F.max(epoch)).first()[0]
    steps = 0 if last is None else last // chunk + 1
    values = df.select(run, F.col(epoch).alias("_e"), F.col(monitor).cast("double").alias("_v"))
    state = None
    for i in range(max(steps, 1)):
        part = values.filter((F.col("_e") >= i * chunk) & (F.col("_e") < (i + 1) * chunk))
        pieces = part.groupBy(run).agg(
            F.array_sort(F.collect_list(F.struct("_e", "_v"))).alias("_rows")
        )
        empty = [F.lit(None).cast(t) for t in ("double", "bigint", "bigint", "bigint")]
        names = ["best", "best_epoch", "wait", "stop_epoch"]
        if state is None:
            pieces = pieces.select("*", *[c.alias(n) for c, n in zip(empty, names)])
        else:
            # Finished runs pass through; a chunk is joined only to runs still going.
            pieces = state.join(pieces, run, "left")
        state = pieces.select(run, _advance(patience, min_delta).alias("_s")).select(run, "_s.*")
        if steps > 1:
            state = materialize(state, "state")
    return state.drop("wait")


def _advance(patience: int, min_delta: float) -> Column:
    first = F.struct(
        "best", "best_epoch", F.coalesce("wait", F.lit(0).cast("bigint")).alias("wait"), "stop_epoch"
    )

    def step(acc: Column, row: Column) -> Column:
        lower = acc["best"].isNull() | (row["_v"] < acc["best"] - F.lit(min_delta))
        better = _number(row["_v"]) & lower
        wait = F.when(better, F.lit(0)).otherwise(acc["wait"] + 1).cast("bigint")
        after = F.struct(
            F.when(better, row["_v"]).otherwise(acc["best"]).alias("best"),
            F.when(better, row["_e"]).otherwise(acc["best_epoch"]).alias("best_epoch"),
            wait.alias("wait"),
            F.when(wait >= patience, row["_e"]).alias("stop_epoch"),
        )
        return F.when(acc["stop_epoch"].isNotNull(), acc).otherwise(after)

    none = F.array().cast("array<struct<_e:bigint,_v:double>>")
    return F.aggregate(F.coalesce("_rows", none), first, step)


def checkpoints(df: DataFrame, run: str, epoch: str, monitor: str, period: int) -> DataFrame:
    """Epochs whose weights are saved: looked at every ``period`` epochs, kept when lower
    than at every earlier look. Returned as the last saved epoch per run; null and NaN are
    never saved."""
    looked = df.filter((F.pmod(F.col(epoch) + 1, F.lit(period)) == 0) & _number(F.col(monitor)))
    key = F.struct(F.col(monitor), F.col(epoch))
    return looked.groupBy(run).agg(
        F.min_by(F.col(epoch), key).alias("saved_epoch"), F.min(monitor).alias("saved_value")
    )


def history_long(df: DataFrame, run: str, epoch: str, metrics: list[str]) -> DataFrame:
    """One row per run, epoch and metric."""
    return df.select(run, epoch, *metrics).unpivot([run, epoch], metrics, "metric", "value")


def history_wide(df: DataFrame, run: str, epoch: str, metrics: list[str]) -> DataFrame:
    """One row per run and epoch with a column per metric."""
    return df.groupBy(run, epoch).pivot("metric", metrics).agg(F.first("value"))
