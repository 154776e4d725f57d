"""Unusual days by z-score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import flag, ratio
from ..schema import ID
from ..session import with_scalars

EPS = 1e-6


def anomaly_global(df: DataFrame, value: str = "total_kwh", limit: float = 3.0) -> DataFrame:
    """z with the mean and sample std of the whole table."""
    stats = df.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    z = ratio(F.col(value) - F.col("__m"), F.col("__s"))
    return (
        with_scalars(df.where(F.col(value).isNotNull()), stats)
        .withColumn("zscore_global", z)
        .withColumn("is_anomaly_global", flag(F.abs("zscore_global") > limit))
        .drop("__m", "__s")
    )


def anomaly_household(
    df: DataFrame, value: str = "total_kwh", limit: float = 2.5, eps: float = EPS
) -> DataFrame:
    """z within the household; eps=0 leaves the spread bare (constant household -> NULL)."""
    w = Window.partitionBy(ID)
    z = ratio(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w) + F.lit(eps))
    return df.where(F.col(value).isNotNull()).withColumn("zscore_personal", z).withColumn(
        "is_anomaly_personal", flag(F.abs("zscore_personal") > limit)
    )


def anomaly_rate(df: DataFrame, flag_col: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(flag_col).alias("anomalies"),
        F.avg(flag_col).alias("rate"),
    )


def anomaly_rate_by(df: DataFrame, key: str, flag_col: str = "is_anomaly_personal") -> DataFrame:
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.sum(flag_col).alias("anomalies"),
            F.avg(flag_col).alias("rate"),
        )
        .orderBy(F.desc("rate"), key)
    )


def outlier_cap_rule(
    df: DataFrame, value: str = "total_kwh", z: float = 3.0, max_daily: float = 100.0
) -> DataFrame:
    """Rows beyond the z limit or above the configured daily maximum, with both reasons."""
    out = anomaly_global(df, value, z).withColumn("is_above_max", flag(F.col(value) > max_daily))
    return out.where((F.col("is_anomaly_global") == 1) | (F.col("is_above_max") == 1))
