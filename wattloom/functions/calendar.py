"""Calendar columns derived from the day."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DAY, REGULAR_DAY, SEASON_MONTHS, WEEKDAY_NAMES
from ..session import with_scalars
from .common import flag


def season_of(month: Column) -> Column:
    out = F.lit("Unknown")
    for name, months in SEASON_MONTHS.items():
        out = F.when(month.isin(months), name).otherwise(out)
    return out


def calendar_basic(df: DataFrame, day: str = DAY) -> DataFrame:
    """dayofweek (Monday = 0), month, day_of_year and the weekday flags."""
    d = F.col(day)
    dow = F.weekday(d)
    return df.withColumns(
        {
            "dayofweek": dow,
            "month": F.month(d),
            "day_of_year": F.dayofyear(d),
            "is_weekend": flag(dow >= 5),
            "is_weekday": flag(dow < 5),
            "is_monday": flag(dow == 0),
            "is_friday": flag(dow == 4),
        }
    )


def month_of_day(df: DataFrame, day: str = DAY) -> DataFrame:
    return df.withColumn("month", F.month(day))


def season_of_month(df: DataFrame, month: str = "month") -> DataFrame:
    return df.withColumn("season", season_of(F.col(month)))


def cyclical_encoding(df: DataFrame) -> DataFrame:
    """Sine and cosine of month (period 12) and dayofweek (period 7)."""
    turn = 2 * math.pi
    cols = {}
    for c, n in (("month", 12), ("dayofweek", 7)):
        angle = F.lit(turn) * F.col(c) / F.lit(float(n))
        cols[f"{c}_sin"], cols[f"{c}_cos"] = F.sin(angle), F.cos(angle)
    return df.withColumns(cols)


def season_flags(df: DataFrame) -> DataFrame:
    s = F.col("season")
    return df.withColumns(
        {
            "is_winter": flag(s == "Winter"),
            "is_summer": flag(s == "Summer"),
            "is_shoulder_season": flag(s.isin("Spring", "Autumn")),
        }
    )


def holiday_flags(df: DataFrame) -> DataFrame:
    """Flags from holiday_category, alone and crossed with weekday / weekend."""
    c = F.col("holiday_category")
    holiday = flag(c != REGULAR_DAY)
    return df.withColumns(
        {
            "is_holiday": holiday,
            "is_christmas": flag(c == "Christmas"),
            "is_new_year": flag(c == "New Year"),
            "is_bank_holiday": flag(c == "Bank Holiday"),
            "holiday_weekday": holiday * F.col("is_weekday"),
            "holiday_weekend": holiday * F.col("is_weekend"),
        }
    )


def peak_period_flags(df: DataFrame, unit: str = "slot") -> DataFrame:
    """Flags on the peak position; unit="hour" turns the slot index into a clock hour first."""
    p = F.col("peak_hour")
    if unit == "hour":
        p = F.floor(p / 2).cast("int")
    morning, evening = flag(p.isin(7, 8, 9)), flag(p.isin(17, 18, 19, 20))
    return df.withColumns(
        {
            "is_morning_peak": morning,
            "is_evening_peak": evening,
            "is_off_peak": flag(p.between(0, 5)),
            "weekday_evening_peak": F.col("is_weekday") * evening,
            "weekend_peak_shift": F.col("is_weekend") * morning,
        }
    )


def time_trend(df: DataFrame, day: str = DAY, days: DataFrame | None = None) -> DataFrame:
    """Days since the first day of the whole table (or of `days`, which holds its days), quarter and
    its flags."""
    start = (df if days is None else days).agg(F.min(day).alias("__start"))
    q = F.quarter(day)
    return (
        with_scalars(df, start)
        .withColumns(
            {
                "days_since_start": F.datediff(F.col(day), F.col("__start")),
                "quarter": q,
                "is_q1": flag(q == 1),
                "is_q4": flag(q == 4),
            }
        )
        .drop("__start")
    )


def day_type(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "day_type",
        F.when(F.col("is_holiday") == 1, "Holiday")
        .when(F.col("is_weekend") == 1, "Weekend")
        .otherwise("Weekday"),
    )


def weekday_name(df: DataFrame) -> DataFrame:
    """Name of dayofweek, and the weekend flag taken from the name."""
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    name = F.get(names, F.col("dayofweek"))
    return df.withColumns({"weekday_name": name, "weekend_by_name": flag(name.isin("Saturday", "Sunday"))})


def period_keys(df: DataFrame, day: str = DAY) -> DataFrame:
    return df.withColumns(
        {
            "month_period": F.trunc(day, "MM"),
            "month_day": F.date_format(day, "MM-dd"),
            "year": F.year(day),
        }
    )
