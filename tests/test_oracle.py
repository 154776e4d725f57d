"""Queries beside their SQL twins on the smallest tables. ALL_QUERIES=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from workload.check import differences, duck

SAMPLE = [
    "pack_readings",
    "interpolate_profile",
    "interpolate_weather_time",
    "merge_all",
    "cleaning_report",
    "encode_category_codes",
    "tod_blocks_by_hours",
    "wind_quantile_flags",
    "temp_sensitivity",
    "feature_table",
    "rolling_plain",
    "sequences",
    "split_per_household",
    "rolling_origin_folds",
    "five_number_by_acorn",
    "crosstab_row_pct",
    "equal_width_bins",
    "anomaly_rate_by_season",
    "cluster_stability",
    "cluster_switching_count_first",
    "seasonal_decompose",
    "group_importance",
    "local_insights",
    "residual_rows",
    "metrics_by_cluster",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, sf, name):
    assert differences(entry.queries()[name](spark, sf), duck(sf), entry.oracle_sql()[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert {"LCLid", "day", "lag1_total", "roll7_total_mean"} <= set(df.columns)
    assert df.count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
