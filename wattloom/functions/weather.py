"""Weather columns and their interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ID
from ..session import with_scalars
from .common import flag, masked_corr

HEATING_BASE, COOLING_BASE = 15.0, 22.0


def temp_features(df: DataFrame, heating: float = HEATING_BASE, cooling: float = COOLING_BASE) -> DataFrame:
    """Range, average and degree days. greatest() would hide a NULL, so it is guarded."""
    hi, lo = F.col("temperatureMax"), F.col("temperatureMin")
    avg = (hi + lo) / 2
    known = avg.isNotNull()
    return df.withColumns(
        {
            "temp_range": hi - lo,
            "temp_avg": avg,
            "heating_degree_days": F.when(known, F.greatest(F.lit(heating) - avg, F.lit(0.0))),
            "cooling_degree_days": F.when(known, F.greatest(avg - F.lit(cooling), F.lit(0.0))),
        }
    )


def temp_extremes(df: DataFrame) -> DataFrame:
    t = F.col("temp_avg")
    return df.withColumns({"is_very_cold": flag(t < 5), "is_very_hot": flag(t > 25)})


def humidity_cloud_flags(df: DataFrame) -> DataFrame:
    h, c = F.col("humidity"), F.col("cloudCover")
    return df.withColumns(
        {
            "is_high_humidity": flag(h > 0.8),
            "is_low_humidity": flag(h < 0.3),
            "is_cloudy": flag(c > 0.7),
            "is_clear": flag(c < 0.3),
        }
    )


def wind_quantile_flags(df: DataFrame, approx: bool = False, fit_on=None, days: DataFrame | None = None) -> DataFrame:
    """Above the upper / below the lower quartile of wind over all rows (or those in `fit_on`).
    `days` may hold the table's windSpeed with the number of its rows, `n`, in place of the rows."""
    from ..operators.quantiles import quantiles

    if days is None:
        src = df if fit_on is None else df.where(fit_on)
        q = quantiles(src, "windSpeed", [0.25, 0.75], approx=approx)
    else:
        q = quantiles(days, "windSpeed", [0.25, 0.75], weight="n")
    q = q.select(F.col("q").alias("__q"))
    w = F.col("windSpeed")
    return (
        with_scalars(df, q)
        .withColumns({"is_windy": flag(w > F.col("__q")[1]), "wind_calm": flag(w < F.col("__q")[0])})
        .drop("__q")
    )


def temp_sensitivity(df: DataFrame) -> DataFrame:
    """Per household correlation of use with average temperature."""
    return df.withColumn(
        "temp_sensitivity", masked_corr("total_kwh", "temp_avg", Window.partitionBy(ID))
    )


def temp_impact(df: DataFrame) -> DataFrame:
    """As temp_sensitivity with the day's maximum, 0 for households of one row."""
    w = Window.partitionBy(ID)
    return df.withColumn(
        "temp_impact",
        F.when(F.count(F.lit(1)).over(w) > 1, masked_corr("total_kwh", "temperatureMax", w)).otherwise(0.0),
    )


def season_weather_need(df: DataFrame) -> DataFrame:
    s = F.col("season")
    return df.withColumns(
        {
            "winter_heating_need": flag(s == "Winter") * F.col("heating_degree_days"),
            "summer_cooling_need": flag(s == "Summer") * F.col("cooling_degree_days"),
        }
    )


def weather_interactions(df: DataFrame) -> DataFrame:
    """Calendar flags times degree days, and holiday times use."""
    hdd, cdd = F.col("heating_degree_days"), F.col("cooling_degree_days")
    return df.withColumns(
        {
            "weekend_heating": F.col("is_weekend") * hdd,
            "weekday_heating": F.col("is_weekday") * hdd,
            "summer_cooling": F.col("is_summer") * cdd,
            "holiday_consumption_boost": F.col("is_holiday") * F.col("total_kwh"),
        }
    )
