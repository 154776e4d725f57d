"""Table schemas and the fixed values the analyses depend on."""

from __future__ import annotations

from pyspark.sql import types as T

SLOTS = 48
HH_COLS = [f"hh_{i}" for i in range(SLOTS)]
ID, DAY, TARGET, PROFILE = "LCLid", "day", "total_kwh", "hh"

CONSUMPTION = T.StructType(
    [T.StructField(ID, T.StringType()), T.StructField(DAY, T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in HH_COLS]
)
HOUSEHOLD = T.StructType(
    [T.StructField(c, T.StringType()) for c in (ID, "stdorToU", "Acorn", "Acorn_grouped")]
)
WEATHER_VALUES = ["temperatureMax", "temperatureMin", "humidity", "windSpeed", "cloudCover"]
WEATHER = T.StructType(
    [T.StructField("time", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in WEATHER_VALUES]
)
HOLIDAY = T.StructType(
    [T.StructField("Bank holidays", T.DateType()), T.StructField("Type", T.StringType())]
)
READINGS = T.StructType(
    [
        T.StructField(ID, T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("kwh", T.DoubleType()),
    ]
)

# --- fixed values -----------------------------------------------------------

# Holiday name -> category. The '?' stands for an apostrophe lost in the public file.
HOLIDAY_CATEGORY = {
    "New Year?s Day": "New Year",
    "New Year?s Day (substitute day)": "New Year",
    "Christmas Day": "Christmas",
    "Boxing Day": "Christmas",
    "Easter Monday": "Easter",
    "Good Friday": "Easter",
    "Summer bank holiday": "Bank Holiday",
    "Early May bank holiday": "Bank Holiday",
    "Spring bank holiday": "Bank Holiday",
    "Spring bank holiday (substitute day)": "Bank Holiday",
    "Queen?s Diamond Jubilee (extra bank holiday)": "Bank Holiday",
}
REGULAR_DAY = "Regular Day"

SEASON_MONTHS = {
    "Winter": [12, 1, 2],
    "Spring": [3, 4, 5],
    "Summer": [6, 7, 8],
    "Autumn": [9, 10, 11],
}

WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Period -> half-open slot ranges. "slots" reads the period numbers as slots, the default
# for result parity; "hours" reads them as clock hours; "fallback" is the plotting variant.
PERIODS = {
    "slots": {
        "morning": [(6, 12)],
        "afternoon": [(12, 18)],
        "evening": [(18, 24)],
        "night": [(0, 6), (24, 48)],
        "peak_period": [(34, 40)],
        "off_peak": [(0, 12)],
    },
    "hours": {
        "morning": [(12, 24)],
        "afternoon": [(24, 36)],
        "evening": [(36, 48)],
        "night": [(0, 12)],
        "peak_period": [(34, 42)],
        "off_peak": [(0, 12), (14, 32), (46, 48)],
    },
    "fallback": {
        "morning": [(6, 12)],
        "afternoon": [(24, 36)],
        "evening": [(36, 48)],
        "night": [(0, 6)],
    },
}

# Columns made from the day's own readings: they would leak the target.
LEAKING_PREFIXES = [
    "mean_kwh",
    "std_kwh",
    "peak_kwh",
    "min_kwh",
    "morning_kwh",
    "afternoon_kwh",
    "evening_kwh",
    "night_kwh",
    "peak_period_kwh",
    "off_peak_kwh",
    "base_load",
    "load_factor",
    "daily_variability",
    "coefficient_of_variation",
    "usage_concentration",
    "peak_sharpness",
    "peak_to_mean_ratio",
    "peak_to_total_ratio",
    "day_night_ratio",
    "holiday_consumption_boost",
    "base_load_ratio",
    "consumption_sharpness",
]

# A driver-study input may not contain one of these ("{t}" is the target's name).
DRIVER_EXCLUDED = [
    "LCLid",
    "day",
    "holiday_type",
    "{t}",
    "total_kwh",
    "mean_kwh",
    "std_kwh",
    "peak_kwh",
    "min_kwh",
    "morning_kwh",
    "afternoon_kwh",
    "evening_kwh",
    "night_kwh",
    "peak_period_kwh",
    "off_peak_kwh",
    "base_load",
    "load_factor",
    "lag1_{t}",
    "lag7_{t}",
    "lag14_{t}",
    "lag1_total",
    "lag7_total",
    "lag14_total",
    "roll7_{t}_mean",
    "roll7_{t}_std",
    "roll7_total_mean",
    "roll7_total_std",
    "roll14_total_mean",
    "roll14_total_std",
    "delta1_{t}",
    "delta7_{t}",
    "delta1_total",
    "delta7_total",
    "delta14_total",
    "pct_change_{t}",
    "pct_change1_total",
    "pct_change7_total",
    "daily_variability",
    "coefficient_of_variation",
    "sharpness",
    "concentration",
]
RANDOM_STUDY_EXCLUDED = ["LCLid", "day", "hh_", "holiday_type"]

# Column groups by name rule: "has" = contains, "starts" = prefix, "token" = equal or prefix + "_".
FORECAST_GROUPS = {
    "temporal": ("token", ["dayofweek", "is_weekend", "is_holiday", "month", "day_of_year", "quarter"]),
    "weather": (
        "has",
        ["temp", "temperature", "heating_degree", "cooling_degree", "precip", "rain", "snow"],
    ),
    "lags": ("starts", ["lag"]),
    "rolling": ("starts", ["roll"]),
    "interactions": (
        "starts",
        ["lag1_weekend", "lag1_holiday", "lag1_summer", "lag7_weekend", "lag7_holiday", "lag7_summer"],
    ),
    "static_household": ("is", ["Acorn", "Acorn_grouped", "stdorToU"]),
    "static_group": ("starts", ["cluster_"]),
}
WEATHER_WORDS = ["temp", "heating", "cooling", "humidity", "wind", "cloud"]
RANDOM_STUDY_GROUPS = {
    "weather": ("has", WEATHER_WORDS),
    "calendar": ("has", ["dayofweek", "weekend", "month", "season", "holiday", "quarter"]),
    "socio_economic": ("has", ["acorn", "Acorn"]),
    "past_use": ("has", ["lag", "roll", "delta", "pct_change"]),
    "consumption_patterns": ("has", ["ratio", "variability", "concentration", "sharpness", "load_factor"]),
    "time_of_day": ("has", ["morning", "afternoon", "evening", "night", "peak_period", "off_peak"]),
    "interactions": ("has", ["weekend_heating", "summer_cooling", "holiday_"]),
}
DATED_STUDY_GROUPS = {
    "half_hourly": ("starts", ["hh_"]),
    "temporal": ("has", ["dayofweek", "month", "season", "quarter", "holiday", "weekend"]),
    "weather": ("has", WEATHER_WORDS),
    "socio_economic": ("has", ["acorn", "Acorn"]),
    "external": ("has", ["tariff", "ToU", "stdor"]),
}

EXPECTED_COLUMNS = {
    "Basic Features": ["LCLid", "day", "total_kwh", "mean_kwh", "std_kwh", "peak_kwh"],
    "Time Features": ["dayofweek", "is_weekend", "season", "month", "is_holiday"],
    "Weather Features": ["temperatureMax", "temperatureMin", "humidity"],
    "Time-of-Day Features": ["morning_kwh", "afternoon_kwh", "evening_kwh", "night_kwh"],
    "Advanced Features": [
        "is_weekday",
        "peak_to_mean_ratio",
        "day_night_ratio",
        "daily_variability",
        "temp_impact",
    ],
    "Socio-Economic Features": ["Acorn_grouped", "stdorToU"],
}
