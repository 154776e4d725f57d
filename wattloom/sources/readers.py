"""Scans. Columns are picked by header and typed by the schema: no inference pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import nan_to_null
from ..functions.profile import to_array
from ..schema import CONSUMPTION, HH_COLS, HOLIDAY, HOUSEHOLD, WEATHER, WEATHER_VALUES

# directory layout of the raw bundle
LAYOUT = {
    "consumption": "hhblock_dataset/hhblock_dataset/block_*.csv",
    "weather": "weather_daily_darksky.csv",
    "household": "informations_households.csv",
    "holiday": "uk_bank_holidays.csv",
}


def _csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Pick `names` by the header (the same in all blocks) as text; the caller applies types."""
    return spark.read.option("header", True).csv(path).select(*[F.col(f"`{n}`") for n in names])


def scan_halfhourly(spark: SparkSession, path: str, as_array: bool = False) -> DataFrame:
    """All consumption blocks matching a glob, in one scan; text that is not a number is NULL."""
    raw = _csv(spark, path, CONSUMPTION.fieldNames())
    out = raw.select(
        "LCLid",
        F.to_date("day").alias("day"),
        *[nan_to_null(F.col(c).try_cast("double")).alias(c) for c in HH_COLS],
    )
    return to_array(out) if as_array else out


def scan_household(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, HOUSEHOLD.fieldNames())


def scan_weather(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path, WEATHER.fieldNames())
    return raw.select(
        F.col("time").try_cast("timestamp_ntz").alias("time"),
        *[nan_to_null(F.col(c).try_cast("double")).alias(c) for c in WEATHER_VALUES],
    )


def scan_holiday(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path, HOLIDAY.fieldNames())
    return raw.select(F.to_date("Bank holidays").alias("Bank holidays"), "Type")


def load_bundle(spark: SparkSession, root: str, as_array: bool = True) -> dict[str, DataFrame]:
    """The four raw tables under `root`, lazy."""
    at = {k: f"{root.rstrip('/')}/{v}" for k, v in LAYOUT.items()}
    return {
        "consumption": scan_halfhourly(spark, at["consumption"], as_array),
        "weather": scan_weather(spark, at["weather"]),
        "household": scan_household(spark, at["household"]),
        "holiday": scan_holiday(spark, at["holiday"]),
    }


def scan_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The stored feature table; only `columns` reach the Parquet reader."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
