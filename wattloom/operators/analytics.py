"""Data-quality counts, load curves, distributions, crosstabs, bins and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import masked_corr, ratio, rows
from ..schema import DAY, ID, PROFILE, SLOTS
from ..session import with_scalars
from .quantiles import five_number, quantiles



# --- quality -------------------------------------------------------------------


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls) for columns with any, from one aggregate."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols]
    return counts.select(F.inline(F.array(*rows))).where("nulls > 0")


def duplicate_keys(df: DataFrame, keys: Sequence[str] = (ID, DAY)) -> DataFrame:
    return df.groupBy(*keys).agg(rows().alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicates"))


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min(DAY).alias("first_day"), F.max(DAY).alias("last_day"))


def household_coverage(df: DataFrame, approx: bool = False) -> DataFrame:
    days = df.groupBy(ID).agg(F.countDistinct(DAY).alias("days"))
    return five_number(days, "days", approx=approx).select("min", "median", "max")


def active_households_per_day(df: DataFrame, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct(ID) if approx else F.countDistinct(ID)
    return df.groupBy(DAY).agg(count.alias("households"))


def describe_total(df: DataFrame, col: str = "total_kwh", approx: bool = False) -> DataFrame:
    basic = df.agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std")
    )
    return basic.crossJoin(F.broadcast(five_number(df, col, approx=approx).drop("n")))


def histogram(df: DataFrame, col: str = "total_kwh", bins: int = 100) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed."""
    lim = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.floor(ratio(F.col(col) - F.col("__lo"), width))
    b = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    binned = with_scalars(df.where(F.col(col).isNotNull()), lim).select(
        b.alias("bin"), (F.col("__lo") + b * width).alias("bin_start")
    )
    return binned.groupBy("bin").agg(F.min("bin_start").alias("bin_start"), rows().alias("rows"))


# --- load curves -----------------------------------------------------------------


def load_curve(df: DataFrame, keys: Sequence[str] = (), hh: str = PROFILE) -> DataFrame:
    """Mean use per slot by keys: 48 averages in one aggregate, so profiles are not exploded
    before the exchange."""
    means = df.groupBy(*keys).agg(*[F.expr(f"avg(get({hh}, {i}))").alias(f"__{i}") for i in range(SLOTS)])
    curve = F.array(*[f"__{i}" for i in range(SLOTS)])
    return means.select(*keys, F.posexplode(curve).alias("slot", "mean_kwh"))


def peak_slot_histogram(df: DataFrame, keys: Sequence[str] = (), slot: str = "peak_hour") -> DataFrame:
    """Rows and share per peak slot by keys; at most 48 rows per key reach the window."""
    n = df.where(F.col(slot).isNotNull()).groupBy(*keys, slot).agg(rows().alias("rows"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return n.withColumn("share", F.col("rows") / F.sum("rows").over(w))


def mean_sd(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")
    )


def weekday_average(df: DataFrame, value: str = "total_kwh") -> DataFrame:
    return df.groupBy("dayofweek", "weekday_name").agg(F.avg(value).alias("mean_kwh")).orderBy("dayofweek")


# --- crosstabs -------------------------------------------------------------------


def crosstab(
    df: DataFrame, row: str, col: str, values: Sequence[str], distinct_of: str | None = None
) -> DataFrame:
    """Counts of rows (or distinct `distinct_of`), zero-filled, one column per value."""
    count = F.countDistinct(distinct_of) if distinct_of else rows()
    return df.groupBy(row).pivot(col, list(values)).agg(count).na.fill(0)


def crosstab_row_pct(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, pct of the row), from counts."""
    n = df.groupBy(row, col).agg(rows().alias("rows"))
    w = Window.partitionBy(row)
    return n.withColumn("pct", F.col("rows") / F.sum("rows").over(w) * 100)


def high_usage_households(
    df: DataFrame, value: str = "total_kwh", p: float = 0.75, approx: bool = False
) -> DataFrame:
    """Rows of households whose mean is at or above the quantile of household means."""
    means = df.groupBy(ID).agg(F.avg(value).alias("household_mean"))
    cut = quantiles(means, "household_mean", [p], approx=approx).select(F.col("q")[0].alias("__q"))
    ids = with_scalars(means, cut).where(F.col("household_mean") >= F.col("__q")).select(ID)
    return df.join(ids, ID, "left_semi")


def daily_demand(df: DataFrame, value: str = "total_kwh") -> DataFrame:
    return df.groupBy(DAY).agg(F.sum(value).alias("demand_kwh")).orderBy(DAY)


def households_per_cluster(df: DataFrame, cluster: str = "cluster", approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct(ID) if approx else F.countDistinct(ID)
    return df.groupBy(cluster).agg(count.alias("households"))


def seasonal_weather_means(df: DataFrame) -> DataFrame:
    return df.groupBy("season").agg(
        F.avg("temperatureMax").alias("temperature_max"),
        F.avg("humidity").alias("humidity"),
        F.avg("total_kwh").alias("mean_kwh"),
    )


# --- bins and extremes -------------------------------------------------------------


def fixed_bins(df: DataFrame, col: str = "temperatureMax", out: str = "temp_band") -> DataFrame:
    """Right-closed bands (-10,5] Cold, (5,15] Cool, (15,25] Mild, (25,35] Warm; else NULL."""
    c = F.col(col)
    band = None
    for lo, hi, name in ((-10, 5, "Cold"), (5, 15, "Cool"), (15, 25, "Mild"), (25, 35, "Warm")):
        hit = (c > lo) & (c <= hi)
        band = F.when(hit, name) if band is None else band.when(hit, name)
    return df.withColumn(out, band)


def equal_width_bins(
    df: DataFrame, col: str = "heating_degree_days", bins: int = 5, out: str = "hdd_bin"
) -> DataFrame:
    """Right-closed bins of equal width, the lowest value included in bin 1."""
    lim = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.ceil(ratio(F.col(col) - F.col("__lo"), width))
    one = F.when(F.col(col).isNotNull(), F.least(F.greatest(F.coalesce(place, F.lit(1)), F.lit(1)), F.lit(bins)))
    return with_scalars(df, lim).withColumn(out, one.cast("int")).drop("__lo", "__hi")


def extreme_days(
    df: DataFrame,
    col: str = "temperatureMax",
    low: float = 0.05,
    high: float = 0.95,
    approx: bool = False,
) -> DataFrame:
    """Rows below the low or above the high quantile, with the side."""
    q = quantiles(df, col, [low, high], approx=approx).select(F.col("q").alias("__q"))
    side = F.when(F.col(col) > F.col("__q")[1], "high").when(F.col(col) < F.col("__q")[0], "low")
    return with_scalars(df, q).withColumn("extreme", side).drop("__q").where("extreme is not null")


def hdd_corr_by_cluster(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    r = masked_corr("heating_degree_days", "total_kwh").alias("corr")
    return df.groupBy(cluster).agg(r).orderBy(F.desc("corr"), cluster)


def trend_line(df: DataFrame, x: str, y: str = "total_kwh", keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x by keys; NULL slope where x is constant."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        rows().alias("n"),
    )


def top_k_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    """Rows of the k most frequent groups (ties by name)."""
    top = df.where(F.col(group).isNotNull()).groupBy(group).agg(rows().alias("__n"))
    top = top.orderBy(F.desc("__n"), group).limit(k).select(group)
    return df.join(F.broadcast(top), group, "left_semi")


def signature_by_monthday(
    df: DataFrame, clusters: Sequence, cluster: str = "cluster", value: str = "total_kwh"
) -> DataFrame:
    """Mean use per calendar day (MM-dd), one column per cluster."""
    return (
        df.groupBy(F.date_format(DAY, "MM-dd").alias("month_day"))
        .pivot(cluster, list(clusters))
        .agg(F.avg(value))
        .orderBy("month_day")
    )


def monthly_mean_pivot(
    df: DataFrame, clusters: Sequence, cluster: str = "cluster", value: str = "total_kwh"
) -> DataFrame:
    return (
        df.groupBy(F.trunc(DAY, "MM").alias("month_period"))
        .pivot(cluster, list(clusters))
        .agg(F.avg(value))
        .orderBy("month_period")
    )


def monthly_profile_mean(df: DataFrame, cluster: str, hh: str = PROFILE) -> DataFrame:
    """Per month and cluster: the mean of the 48 slot means."""
    curve = load_curve(df.withColumn("month_period", F.trunc(DAY, "MM")), ["month_period", cluster], hh)
    return curve.groupBy("month_period", cluster).agg(F.avg("mean_kwh").alias("mean_of_slots"))


def household_summary(df: DataFrame, household: str | Column, label: str = "label_1") -> DataFrame:
    return (
        df.where(F.col(ID) == household)
        .groupBy(ID)
        .agg(
            F.avg(label).alias("mean"),
            F.min(label).alias("min"),
            F.max(label).alias("max"),
            F.stddev_samp(label).alias("std"),
        )
    )


def quadrants(df: DataFrame, variability: str, cluster: str = "cluster") -> DataFrame:
    """Cluster means against the medians across clusters (one row per cluster)."""
    stats = df.groupBy(cluster).agg(
        F.avg("total_kwh").alias("mean_kwh"), F.avg(variability).alias("mean_variability")
    )
    med = stats.agg(
        F.percentile("mean_kwh", F.lit(0.5)).alias("__k"),
        F.percentile("mean_variability", F.lit(0.5)).alias("__v"),
    )
    hi_k, hi_v = F.col("mean_kwh") >= F.col("__k"), F.col("mean_variability") >= F.col("__v")
    name = (
        F.when(hi_k & hi_v, "Peak Reduction")
        .when(hi_v, "Load Stabilization")
        .when(hi_k, "High use, low variability")
        .otherwise("Low use, low variability")
    )
    return with_scalars(stats, med).withColumn("quadrant", name).drop("__k", "__v")


# --- top-k -----------------------------------------------------------------------


def top_n(df: DataFrame, by: str, n: int, largest: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(by) if largest else F.asc(by), *ties).limit(n)


def top_n_per_key(df: DataFrame, keys: Sequence[str], by: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """n largest per key; Spark keeps n rows per key and task before the exchange."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def most_frequent_household(df: DataFrame) -> DataFrame:
    return df.groupBy(ID).agg(rows().alias("rows")).orderBy(F.desc("rows"), ID).limit(1)


def longest_households(df: DataFrame, n: int = 2) -> DataFrame:
    """The n households with most distinct days and their timelines."""
    top = df.groupBy(ID).agg(F.countDistinct(DAY).alias("days")).orderBy(F.desc("days"), ID).limit(n)
    return df.join(F.broadcast(top), ID)
