"""Scaling, compression and bias terms of feature vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_odds(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """``ln(ones / zeros)``, null without zeros or without ones."""
    ones, zeros = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    ratio = F.try_divide(ones.cast("double"), zeros.cast("double"))
    return df.groupBy(*(by or [])).agg(F.log(F.nullif(ratio, F.lit(0.0))).alias("bias"))


def bit_log_odds(df: DataFrame, bits: str, n_bits: int) -> DataFrame:
    """``ln(ones / zeros)`` over all bits of all sparse fingerprints."""
    ones = F.sum(F.size(bits))
    zeros = F.count(F.col(bits)) * F.lit(n_bits) - ones
    ratio = F.try_divide(ones.cast("double"), zeros.cast("double"))
    return df.agg(F.log(F.nullif(ratio, F.lit(0.0))).alias("bias"))


def as_vector(df: DataFrame, feature: str, name: str = "features") -> DataFrame:
    """Rows that have the feature, with it as an ML vector."""
    rows = df.filter(F.col(feature).isNotNull())
    if isinstance(df.schema[feature].dataType, VectorUDT):
        return rows.withColumn(name, F.col(feature))
    return rows.withColumn(name, array_to_vector(F.col(feature).cast("array<double>")))


def standardize(df: DataFrame, feature: str, name: str = "scaled") -> DataFrame:
    """Each dimension shifted to mean 0 and scaled to sample standard deviation 1."""
    rows = as_vector(df, feature, "_v")
    model = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s").fit(rows)
    return model.transform(rows).withColumn(name, vector_to_array("_s")).drop("_v", "_s")


def fit_compressor(df: DataFrame, feature: str, k: int) -> PCAModel:
    """Principal components: the optimum a linear encoder of width ``k`` can reach."""
    return PCA(k=k, inputCol="_v", outputCol="_c").fit(as_vector(df, feature, "_v"))


def compress(df: DataFrame, model: PCAModel, feature: str, name: str = "fpcompressed") -> DataFrame:
    """Add the compressed feature; rows without the feature keep a null.

    An empty vector stands in for a missing one while the model runs over all rows, so the
    table is neither split nor joined.
    """
    width = model.pc.numRows
    zero = F.array_repeat(F.lit(0.0), width)
    filled = F.coalesce(F.col(feature).cast("array<double>"), zero)
    out = model.transform(df.withColumn("_v", array_to_vector(filled)))
    kept = F.when(F.col(feature).isNotNull(), vector_to_array("_c").cast("array<float>"))
    return out.withColumn(name, kept).drop("_v", "_c")


def sign_matrix(width: int, k: int, seed: int) -> np.ndarray:
    """Repeatable matrix of +1 and -1 (``width`` x ``k``)."""
    odd = [
        [int(hashlib.md5(f"{seed}|{i}|{j}".encode()).hexdigest()[0], 16) % 2 for j in range(k)]
        for i in range(width)
    ]
    return np.where(np.array(odd) == 1, 1.0, -1.0)


def sign_projection(width: int, k: int, seed: int = 0):
    """Column function: random sign projection of dense vectors to ``k`` dimensions.

    For widths at which the covariance matrix behind PCA gets too large. The matrix depends
    on the widths alone (64 Ki entries for 2048 x 32) and travels with the function.
    """
    matrix = sign_matrix(width, k, seed) / np.sqrt(k)

    def project(batch: pd.Series) -> pd.Series:
        have = np.flatnonzero(batch.notna())
        out = np.full(len(batch), None, dtype=object)
        if len(have):
            stacked = np.stack(batch.iloc[have].to_list()).astype(float)
            for i, row in zip(have, stacked @ matrix):
                out[i] = row
        return pd.Series(out, index=batch.index)

    udf = F.pandas_udf(project, "array<double>")
    return lambda column: udf(column.cast("array<double>"))


def positions(df: DataFrame, key: str, feature: str) -> DataFrame:
    """Long form ``(key, pos, x)`` of an array column."""
    return df.select(key, F.posexplode(feature).alias("pos", "x"))


def set_bits(df: DataFrame, key: str, feature: str) -> DataFrame:
    """Long form ``(key, bit)`` of a sparse fingerprint.

    With a plain explode Spark would first filter on the fingerprint's size, and for that
    compute a fingerprint that is still an expression a second time.
    """
    return df.select(key, F.explode_outer(feature).alias("bit")).filter(F.col("bit").isNotNull())


def spread_columns(df: DataFrame, feature: str, width: int, prefix: str = "x") -> DataFrame:
    """The first ``width`` entries of an array as columns."""
    entry: list[Column] = [F.get(F.col(feature), F.lit(i)).alias(f"{prefix}{i}") for i in range(width)]
    return df.select("*", *entry).drop(feature)
