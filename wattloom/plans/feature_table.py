"""The composed jobs: raw tables -> clean panel -> feature table -> model-ready splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import profile as prof
from ..functions import weather as wx
from ..operators import clean, columns, encode, panel, splits
from ..schema import DAY, ID, PROFILE, TARGET


def clean_weather(raw: DataFrame) -> DataFrame:
    """time + values -> one gap-filled row per day."""
    return clean.interpolate_weather_time(clean.dedup_weather_days(clean.select_weather_cols(raw)))


def clean_and_merge(
    consumption: DataFrame,
    household: DataFrame,
    weather: DataFrame,
    holiday: DataFrame,
    share: float = clean.MISSING_SHARE,
    min_days: int = clean.MIN_DAYS,
) -> DataFrame:
    """Clean profiles with the three dimensions, month and season."""
    df = clean.drop_sparse_days(consumption, share)
    df = clean.keep_active_households(df, min_days)
    df = clean.interpolate_profile(df)
    df = clean.merge_all(
        df,
        clean.select_household_cols(household),
        clean_weather(weather),
        clean.map_holiday_category(holiday),
    )
    return cal.season_of_month(cal.month_of_day(df))


def day_counts(df: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """(day, windSpeed, n): how many rows a day has. Global statistics read this small table: it has
    the length of the calendar and is combined map-side. With `weather`, `df` may be the readings
    before any join: their days are counted and the few days joined, not the readings."""
    n = F.count(F.lit(1)).alias("n")
    if weather is None:
        return df.groupBy(DAY, "windSpeed").agg(n)
    return clean.join_weather(df.groupBy(DAY).agg(n), weather.select(DAY, "windSpeed"))


def calendar_features(df: DataFrame, trend: bool = True, days: DataFrame | None = None) -> DataFrame:
    df = cal.calendar_basic(df)
    if "season" not in df.columns:
        df = cal.season_of_month(df)
    df = cal.season_flags(cal.cyclical_encoding(df))
    if "holiday_category" in df.columns:
        df = cal.holiday_flags(df)
    return cal.time_trend(df, days=days) if trend else df


def weather_features(df: DataFrame, approx: bool = False, days: DataFrame | None = None) -> DataFrame:
    df = wx.humidity_cloud_flags(wx.temp_extremes(wx.temp_features(df)))
    df = wx.wind_quantile_flags(df, approx, days=days)
    return wx.season_weather_need(wx.temp_sensitivity(df))


def feature_table(
    df: DataFrame, approx: bool = False, peak_flags: bool = False, days: DataFrame | None = None
) -> DataFrame:
    """All features; nothing is dropped. Works with a profile column or daily totals only.

    Global statistics (first day, wind quartiles) come from one table of day counts, `days`: made
    from `df` itself, or cheaper by the caller from the readings (see day_counts). All household
    windows share one exchange.
    """
    if days is None and not approx:
        days = day_counts(df)
    # the test keeps the count, and drops no day that has a date, in both uses of the table, so that they have
    # the same plan and the days are counted once
    df = calendar_features(df, days=None if days is None else days.where(f"n > 0 and {DAY} is not null"))
    if PROFILE in df.columns:
        df = prof.consumption_features(df)
        if peak_flags:
            df = cal.peak_period_flags(df)
    # windows ordered by day come first: their sort also serves the unordered household window
    df = weather_features(panel.panel_safe(df), approx, days)
    return panel.interactions_lag(df)


@dataclass
class Prepared:
    """A labelled, split table with its input columns and their groups."""

    data: DataFrame
    features: list[str]
    target: str
    groups: dict[str, list[str]]

    def part(self, split: str) -> DataFrame:
        return self.data.where(F.col("split") == split)


def _prepared(labelled: DataFrame, label: str, target: str, val_days: int, test_days: int) -> Prepared:
    out = splits.split_by_date(columns.drop_leakage_columns(labelled, target), val_days, test_days)
    feats = [c for c in out.columns if c not in (ID, DAY, label, "split", PROFILE)]
    return Prepared(out.drop(PROFILE), feats, label, columns.feature_groups(feats, "forecast"))


def prepare_day_ahead(
    features: DataFrame, target: str = TARGET, val_days: int = 30, test_days: int = 90
) -> Prepared:
    return _prepared(panel.label_day_ahead(features, target), "label_1", target, val_days, test_days)


def prepare_week_ahead(
    features: DataFrame, target: str = TARGET, val_days: int = 30, test_days: int = 90
) -> Prepared:
    """label_7 comes from the same frame, so no join of two big tables is needed."""
    return _prepared(panel.label_week_ahead(features, target), "label_7", target, val_days, test_days)


def prepare_driver_study(
    features: DataFrame, target: str = TARGET, kind: str = "dated_study", val_days: int = 30, test_days: int = 90
) -> Prepared:
    """Inputs for the driver study. The dated study splits by day position; the random one
    drops incomplete rows, encodes text columns and splits by key hash."""
    if PROFILE in features.columns and kind == "dated_study":
        features = prof.to_columns(features)
    cols = columns.study_columns(features.columns, target, kind)
    cols = [c for c in cols if c != PROFILE]
    df = features.select(ID, DAY, *cols, target)
    groups = columns.feature_groups(cols, kind)
    if kind == "dated_study":
        return Prepared(splits.split_by_date_position(df, val_days, test_days), cols, target, groups)
    df = encode.dropna_any(df, [*cols, target])
    for c, t in df.dtypes:
        if t == "string" and c in cols:
            df = encode.encode_labels(df, c, "__code").drop(c).withColumnRenamed("__code", c)
    return Prepared(splits.split_random(df), cols, target, groups)
