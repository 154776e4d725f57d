"""Load-profile columns: everything computed from one row's 48 half-hour slots.

The profile is one array<double> column, so each rule is an array expression on the row and
nothing is shuffled. A NULL slot makes a sum NULL; peaks and minima skip NULL slots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import HH_COLS, PERIODS, PROFILE, SLOTS
from .common import flag, let, ratio

EPS = 1e-6


# --- array expressions -------------------------------------------------------


def array_total(hh: Column) -> Column:
    return F.aggregate(hh, F.lit(0.0), lambda a, x: a + x)


def slots_total(hh: Column, ranges: list[tuple[int, int]]) -> Column:
    out = None
    for lo, hi in ranges:
        part = array_total(F.slice(hh, lo + 1, hi - lo))
        out = part if out is None else out + part
    return out


def array_std(hh: Column, ddof: int = 0) -> Column:
    """Two-pass standard deviation of the row."""
    n = F.size(hh)
    return let(
        array_total(hh) / n,
        lambda m: F.sqrt(
            ratio(
                F.aggregate(hh, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)),
                (n - ddof).cast("double"),
            )
        ),
    )


def array_quantile(hh: Column, p: float, n: int = SLOTS) -> Column:
    """Linear-interpolation quantile of a row of `n` known slots; NULL if one is missing."""
    pos = p * (n - 1)
    lo = math.floor(pos)
    frac = pos - lo
    value = let(
        F.sort_array(hh),
        lambda s: F.get(s, F.lit(lo))
        + F.lit(frac) * (F.get(s, F.lit(min(lo + 1, n - 1))) - F.get(s, F.lit(lo))),
    )
    return F.when(F.forall(hh, lambda x: x.isNotNull()), value)


def first_peak(hh: Column) -> Column:
    """0-based slot of the first maximum; NULL when every slot is missing."""
    return (F.array_position(hh, F.array_max(hh)) - 1).cast("int")


def missing_slots(hh: Column) -> Column:
    return F.size(F.filter(hh, lambda x: x.isNull()))


# --- layout ------------------------------------------------------------------


def to_array(df: DataFrame, name: str = PROFILE) -> DataFrame:
    """hh_0..hh_47 -> one array column."""
    return df.withColumn(name, F.array(*HH_COLS)).drop(*HH_COLS)


def to_columns(df: DataFrame, name: str = PROFILE) -> DataFrame:
    """One array column -> hh_0..hh_47."""
    return df.selectExpr("*", *[f"get({name}, {i}) AS {c}" for i, c in enumerate(HH_COLS)]).drop(name)


def slot_label(slot: Column) -> Column:
    return F.format_string("%02d:%s", F.floor(slot / 2), F.when(slot % 2 == 0, "00").otherwise("30"))


def slot_of(ts: Column) -> Column:
    return (F.hour(ts) * 2 + F.floor(F.minute(ts) / 30)).cast("int")


def slots_of_hour(hour: int) -> tuple[int, int]:
    return 2 * hour, 2 * hour + 1


# --- features ----------------------------------------------------------------


def profile_totals(df: DataFrame, hh: str = PROFILE) -> DataFrame:
    """Sum, mean, population std, max and min over the slots."""
    h = F.col(hh)
    total = array_total(h)
    return df.withColumns(
        {
            "total_kwh": total,
            "mean_kwh": total / F.size(h),
            "std_kwh": array_std(h),
            "peak_kwh": F.array_max(h),
            "min_kwh": F.array_min(h),
        }
    )


def peak_slot(df: DataFrame, hh: str = PROFILE) -> DataFrame:
    return df.withColumn("peak_hour", first_peak(F.col(hh)))


def tod_blocks(df: DataFrame, scheme: str = "slots", hh: str = PROFILE) -> DataFrame:
    """morning / afternoon / evening / night totals under one of the slot schemes."""
    sets = PERIODS[scheme]
    return df.withColumns(
        {f"{p}_kwh": slots_total(F.col(hh), sets[p]) for p in ("morning", "afternoon", "evening", "night")}
    )


def peak_windows(df: DataFrame, scheme: str = "slots", hh: str = PROFILE) -> DataFrame:
    sets = PERIODS[scheme]
    return df.withColumns({f"{p}_kwh": slots_total(F.col(hh), sets[p]) for p in ("peak_period", "off_peak")})


def is_weekday_peak(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "is_weekday_peak", flag((F.col("dayofweek") < 5) & F.col("peak_hour").isin(17, 18, 19, 20))
    )


def load_ratios(df: DataFrame) -> DataFrame:
    """Ratios of the totals and blocks; a zero denominator gives NULL."""
    c = F.col
    return df.withColumns(
        {
            "peak_to_mean_ratio": ratio(c("peak_kwh"), c("mean_kwh")),
            "peak_to_total_ratio": ratio(c("peak_kwh"), c("total_kwh")),
            "day_night_ratio": ratio(
                c("morning_kwh") + c("afternoon_kwh"), c("evening_kwh") + c("night_kwh")
            ),
            "load_factor": ratio(c("mean_kwh"), c("peak_kwh")),
            "coefficient_of_variation": ratio(c("std_kwh"), c("mean_kwh")),
        }
    )


def daily_variability(df: DataFrame, ddof: int = 0, hh: str = PROFILE) -> DataFrame:
    """Row standard deviation: ddof=0 in the features, ddof=1 in the plotting fallback."""
    return df.withColumn("daily_variability", array_std(F.col(hh), ddof))


def usage_concentration(df: DataFrame, hh: str = PROFILE) -> DataFrame:
    h = F.col(hh)
    squares = F.aggregate(h, F.lit(0.0), lambda a, x: a + x * x)
    return df.withColumn(
        "usage_concentration", let(array_total(h), lambda t: ratio(squares, t * t))
    )


def peak_sharpness(df: DataFrame) -> DataFrame:
    return df.withColumn("peak_sharpness", F.col("peak_kwh") / (F.col("mean_kwh") + EPS))


def base_load(df: DataFrame, p: float = 0.1, hh: str = PROFILE) -> DataFrame:
    b = array_quantile(F.col(hh), p)
    return df.withColumns({"base_load": b, "base_load_ratio": ratio(b, F.col("total_kwh"))})


def day_night_ratio_hours(df: DataFrame, zero_as: float | None = None, hh: str = PROFILE) -> DataFrame:
    """06:00-18:00 over the rest of the day; `zero_as` replaces a zero night."""
    h = F.col(hh)
    night = slots_total(h, [(0, 12), (36, 48)])
    if zero_as is not None:
        night = F.when(night == 0, F.lit(zero_as)).otherwise(night)
    return df.withColumn("day_night_hours", ratio(slots_total(h, [(12, 36)]), night))


def row_cv(df: DataFrame, hh: str = PROFILE) -> DataFrame:
    """Sample std over mean of the row, 0 where the mean is not positive."""
    h = F.col(hh)
    mean = array_total(h) / F.size(h)
    return df.withColumn(
        "calculated_variability", F.when(mean > 0, array_std(h, 1) / mean).otherwise(0.0)
    )


def gini(df: DataFrame, hh: str = PROFILE) -> DataFrame:
    """Inequality of the slots: 0 = flat day, near 1 = all use in one slot."""
    n = F.size(hh)
    weighted = F.aggregate(
        F.transform(F.sort_array(hh), lambda x, i: (2 * (i + 1) - n - 1) * x), F.lit(0.0), lambda a, x: a + x
    )
    return df.withColumn("gini", ratio(weighted, n * array_total(F.col(hh))))


def consumption_features(df: DataFrame, scheme: str = "slots", hh: str = PROFILE) -> DataFrame:
    """All profile columns of the feature table."""
    df = profile_totals(df, hh)
    df = peak_slot(df, hh)
    df = tod_blocks(df, scheme, hh)
    df = peak_windows(df, scheme, hh)
    if "dayofweek" in df.columns:
        df = is_weekday_peak(df)
    df = load_ratios(df).withColumn("daily_variability", F.col("std_kwh"))
    df = usage_concentration(df, hh)
    df = peak_sharpness(df)
    return base_load(df, hh=hh)


def fill_missing_features(df: DataFrame, hh: str = PROFILE) -> DataFrame:
    """Add the columns the cluster analytics expect and the table lacks, by fallback rules.

    The checks run on df.columns while the plan is built. Day/night ratio comes before the
    blocks are filled, so without blocks it stays absent.
    """
    from .weather import temp_impact

    have = set(df.columns)
    if "is_weekday" not in have:
        if "is_weekend" in have:
            df = df.withColumn("is_weekday", 1 - F.col("is_weekend"))
        elif "dayofweek" in have:
            df = df.withColumn("is_weekday", flag(F.col("dayofweek") < 5))
    if "peak_to_mean_ratio" not in have and {"peak_kwh", "mean_kwh"} <= have:
        df = df.withColumn("peak_to_mean_ratio", ratio(F.col("peak_kwh"), F.col("mean_kwh")))
    blocks = ["morning_kwh", "afternoon_kwh", "evening_kwh", "night_kwh"]
    if "day_night_ratio" not in have and set(blocks) <= have:
        day = F.col("morning_kwh") + F.col("afternoon_kwh")
        df = df.withColumn("day_night_ratio", ratio(day, F.col("evening_kwh") + F.col("night_kwh")))
    if "daily_variability" not in have and hh in have:
        df = daily_variability(df, 1, hh)
    if "temp_impact" not in have and {"temperatureMax", "total_kwh"} <= have:
        df = temp_impact(df)
    if not set(blocks) <= have and hh in have:
        df = tod_blocks(df, "fallback", hh)
    if hh in have:
        h = F.col(hh)
        rules = {
            "total_kwh": array_total(h),
            "mean_kwh": array_total(h) / F.size(h),
            "std_kwh": array_std(h, 1),
            "peak_kwh": F.array_max(h),
        }
        df = df.withColumns({k: v for k, v in rules.items() if k not in have})
    return df
