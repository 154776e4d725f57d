"""Per-household lags, rolling windows, labels and sequences.

Every window is partitioned by household and ordered by day, so one exchange and one sort
serve the whole family. The panel key (household, day) is unique, so a window partition is
never longer than the calendar: no household can hold more than one row per day. Lags count
rows, not calendar days, as the analyses require.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import ratio
from ..schema import DAY, ID

EPS = 1e-6
# configured look-backs
LAG_SETS = {"default": [1, 2, 3, 7, 14, 30], "long": [30, 60, 90]}
WINDOW_SETS = {"default": [3, 7, 14, 30], "long": [60, 90]}
HORIZONS = [1, 7, 30]


def by_day(key: str | Sequence[str] = ID):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(DAY)


def _token(target: str) -> str:
    return target.split("_")[0]


def lags_safe(df: DataFrame, target: str = "total_kwh", lags: Sequence[int] = (1, 7, 14)) -> DataFrame:
    w = by_day()
    return df.select("*", *[F.lag(target, k).over(w).alias(f"lag{k}_total") for k in lags])


def rolling_mean_safe(
    df: DataFrame, target: str = "total_kwh", windows: Sequence[int] = (7, 14)
) -> DataFrame:
    """Mean of the previous w rows, the current one left out."""
    w = by_day()
    return df.select(
        "*", *[F.avg(target).over(w.rowsBetween(-n, -1)).alias(f"roll{n}_total_mean") for n in windows]
    )


def delta_safe(df: DataFrame, target: str = "total_kwh") -> DataFrame:
    """Change from two rows back to one row back, absolute and relative."""
    w = by_day()
    l1, l2 = F.lag(target, 1).over(w), F.lag(target, 2).over(w)
    return df.select(
        "*",
        F.coalesce(l1 - l2, F.lit(0.0)).alias("delta1_total"),
        F.when(F.abs(l2) > 0, (l1 - l2) / (l2 + EPS)).otherwise(0.0).alias("pct_change1_total"),
    )


def panel_safe(
    df: DataFrame,
    target: str = "total_kwh",
    lags: Sequence[int] = (1, 7, 14),
    windows: Sequence[int] = (7, 14),
) -> DataFrame:
    """Lags, rolling means and deltas of the feature table in one projection."""
    return delta_safe(rolling_mean_safe(lags_safe(df, target, lags), target, windows), target)


def lags_plain(df: DataFrame, target: str = "total_kwh", lags: Sequence[int] = (1, 7, 14)) -> DataFrame:
    w = by_day()
    return df.select("*", *[F.lag(target, k).over(w).alias(f"lag{k}_{_token(target)}") for k in lags])


def rolling_plain(
    df: DataFrame, target: str = "total_kwh", windows: Sequence[int] = (7, 14)
) -> DataFrame:
    """Mean and sample std of the last w rows, the current one included."""
    cols = []
    for n in windows:
        w = by_day().rowsBetween(-(n - 1), 0)
        cols.append(F.avg(target).over(w).alias(f"roll{n}_{_token(target)}_mean"))
        cols.append(F.stddev_samp(target).over(w).alias(f"roll{n}_{_token(target)}_std"))
    return df.select("*", *cols)


def change_plain(df: DataFrame, target: str = "total_kwh") -> DataFrame:
    lag1 = F.lag(target, 1).over(by_day())
    delta = F.col(target) - lag1
    return df.select(
        "*",
        delta.alias(f"delta1_{_token(target)}"),
        ratio(delta, lag1 + EPS).alias(f"pct_change1_{_token(target)}"),
    )


def weekly_change(df: DataFrame, target: str = "total_kwh") -> DataFrame:
    return df.withColumn(
        f"weekly_change_{_token(target)}", F.col(target) - F.lag(target, 7).over(by_day())
    )


def extended_lags(df: DataFrame, target: str = "total_kwh", which: str = "default") -> DataFrame:
    return rolling_mean_safe(lags_safe(df, target, LAG_SETS[which]), target, WINDOW_SETS[which])


def interactions_lag(df: DataFrame) -> DataFrame:
    lag = F.col("lag1_total")
    share = ratio(lag, lag + EPS)

    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return df.withColumns(
        {
            "lag1_weekend_heating": or_zero(F.col("is_weekend") * F.col("heating_degree_days") * share),
            "lag1_holiday_consumption": or_zero(F.col("is_holiday") * lag),
            "lag1_summer_cooling": or_zero(F.col("is_summer") * F.col("cooling_degree_days") * share),
        }
    )


def label_horizon(df: DataFrame, horizon: int, target: str = "total_kwh") -> DataFrame:
    """label_h: the target h rows ahead (one row's value, not a sum); rows without it go."""
    name = f"label_{horizon}"
    return df.withColumn(name, F.lead(target, horizon).over(by_day())).where(F.col(name).isNotNull())


def label_day_ahead(df: DataFrame, target: str = "total_kwh") -> DataFrame:
    return label_horizon(df, 1, target)


def label_week_ahead(df: DataFrame, target: str = "total_kwh") -> DataFrame:
    return label_horizon(df, 7, target)


def join_week_label(features: DataFrame, raw: DataFrame) -> DataFrame:
    """label_7 made on a separate table of daily totals, joined on household and day."""
    labels = label_week_ahead(raw.select(ID, DAY, "total_kwh")).select(ID, DAY, "label_7")
    return features.join(labels, [ID, DAY], "left").where(F.col("label_7").isNotNull())


def sequences(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    seq_len: int = 14,
    keys: Sequence[str] = (ID,),
    extra: Sequence[str] = (),
) -> DataFrame:
    """X: feature vectors of the previous `seq_len` rows; y: the target of this row.

    collect_list drops NULLs, so vectors are collected whole and tested inside. Passing
    "split" in `keys` keeps a window inside its split.
    """
    w = by_day(keys).rowsBetween(-seq_len, -1)
    vector = F.array(*[F.col(f).cast("double") for f in features])
    out = df.select(
        *keys, DAY, *extra, F.col(target).cast("double").alias("y"), F.collect_list(vector).over(w).alias("X")
    )
    whole = F.forall("X", lambda v: F.forall(v, lambda x: x.isNotNull()))
    return out.where((F.size("X") == seq_len) & F.col("y").isNotNull() & whole)


def prev_cluster(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.withColumn("prev_cluster", F.lag(cluster).over(by_day()))


def household_relatives(df: DataFrame, value: str = "total_kwh") -> DataFrame:
    """Household statistics and the day's value relative to mean and maximum."""
    from .clean import join_back_stats

    out = join_back_stats(df, value)
    return out.withColumns(
        {
            "daily_vs_hh_avg": ratio(F.col(value), F.col("hh_avg_consumption")),
            "daily_vs_hh_max": ratio(F.col(value), F.col("hh_max_consumption")),
        }
    )


def acorn_relatives(df: DataFrame, value: str = "total_kwh", group: str = "Acorn_grouped") -> DataFrame:
    """The household and the day relative to the household's group: group mean and spread, the day's
    value over the group mean, the group's peak over its mean, and the household's spread over the
    group's (sample standard deviations).

    The household's spread is a window over the household, on the exchange that all panel windows
    share. A group may hold a third of all rows, so its statistics come from a map-side combined
    aggregate: one row per published category, which is what is broadcast.
    """
    stats = df.groupBy(F.col(group).alias("__g")).agg(
        F.avg(value).alias("acorn_mean_consumption"),
        F.max(value).alias("__peak"),
        F.stddev_samp(value).alias("acorn_variability"),
    )
    spread = F.stddev_samp(value).over(Window.partitionBy(ID))
    out = df.withColumn("__spread", spread).join(F.broadcast(stats), F.col(group).eqNullSafe(F.col("__g")), "left")
    mean, sd = F.col("acorn_mean_consumption"), F.col("acorn_variability")
    return out.withColumns(
        {
            "household_vs_acorn": ratio(F.col(value), mean),
            "acorn_peak_ratio": ratio(F.col("__peak"), mean),
            "acorn_relative_variability": ratio(F.col("__spread"), sd),
        }
    ).drop("__g", "__peak", "__spread")


def sort_panel(df: DataFrame) -> DataFrame:
    """Total order by household and day (range exchange, so a long household is split too)."""
    return df.orderBy(ID, DAY)
