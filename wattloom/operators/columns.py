"""Column selection by name rule. The rules run on df.columns while the plan is built."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import (
    DATED_STUDY_GROUPS,
    DRIVER_EXCLUDED,
    EXPECTED_COLUMNS,
    FORECAST_GROUPS,
    HH_COLS,
    LEAKING_PREFIXES,
    RANDOM_STUDY_EXCLUDED,
    RANDOM_STUDY_GROUPS,
    TARGET,
)

# same-day columns of this library, beside the published list
OWN_SAME_DAY = [
    "gini",
    "day_night_hours",
    "calculated_variability",
    "household_vs_acorn",
    "zscore",
    "is_anomaly",
    "is_above_max",
    "daily_vs_hh",
    "observed",
    "remainder",
]

MATCH = {
    "has": lambda c, w: w in c,
    "starts": lambda c, w: c.startswith(w),
    "token": lambda c, w: c == w or c.startswith(w + "_"),
    "is": lambda c, w: c == w,
}
GROUP_RULES = {
    "forecast": FORECAST_GROUPS,
    "random_study": RANDOM_STUDY_GROUPS,
    "dated_study": DATED_STUDY_GROUPS,
}


def drop_columns_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def leaking_columns(cols: Sequence[str], target: str = TARGET) -> list[str]:
    """The target, half-hour columns and columns derived from the same day's readings."""

    def leaks(c: str) -> bool:
        return (
            c == target
            or re.fullmatch(r"hh_\d+", c) is not None
            or any(MATCH["token"](c, p) for p in [*LEAKING_PREFIXES, *OWN_SAME_DAY])
        )

    return [c for c in cols if leaks(c)]


def drop_leakage_columns(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.drop(*leaking_columns(df.columns, target))


def study_columns(
    cols: Sequence[str], target: str = TARGET, kind: str = "dated_study", also: Sequence[str] = ()
) -> list[str]:
    """Inputs of a driver study. The dated study keeps half-hour columns, the random one not."""
    if kind == "dated_study":
        words = [w.replace("{t}", target) for w in DRIVER_EXCLUDED] + list(also)
        return [c for c in cols if not any(w in c for w in words) and "kwh" not in c.lower()]
    return [c for c in cols if c != target and not any(w in c for w in RANDOM_STUDY_EXCLUDED)]


def select_study_features(df: DataFrame, target: str = TARGET, kind: str = "dated_study") -> DataFrame:
    return df.select(*study_columns(df.columns, target, kind), target)


def feature_groups(cols: Sequence[str], rules: str = "forecast") -> dict[str, list[str]]:
    """Group name -> columns. A column may be in several groups; "other" takes the rest."""
    groups = {
        g: [c for c in cols if any(MATCH[how](c, w) for w in words)]
        for g, (how, words) in GROUP_RULES[rules].items()
    }
    if rules != "random_study":
        used = {c for cs in groups.values() for c in cs}
        groups["other"] = [c for c in cols if c not in used]
    return groups


def feature_group_table(df: DataFrame, cols: Sequence[str], rules: str = "forecast") -> DataFrame:
    """(feature, group, known_rows) over the table: one aggregate, then one row per pair."""
    pairs = [(c, g) for g, cs in feature_groups(cols, rules).items() for c in cs]
    used = sorted({c for c, _ in pairs})
    counts = df.agg(*[F.count(c).alias(c) for c in used])
    rows = [
        F.struct(F.lit(c).alias("feature"), F.lit(g).alias("group"), F.col(c).alias("known_rows"))
        for c, g in pairs
    ]
    return counts.select(F.inline(F.array(*rows)))


def column_report(df: DataFrame) -> DataFrame:
    """Expected columns by category, whether present, and how many rows have a value."""
    expected = [(g, c) for g, cs in EXPECTED_COLUMNS.items() for c in cs]
    expected += [("Half-Hourly Columns", c) for c in HH_COLS]
    have = set(df.columns)
    counts = df.agg(*[F.count(c).alias(c) for _, c in expected if c in have])
    rows = [
        F.struct(
            F.lit(g).alias("category"),
            F.lit(c).alias("column"),
            F.lit(int(c in have)).alias("present"),
            (F.col(c) if c in have else F.lit(0).cast("bigint")).alias("known_rows"),
        )
        for g, c in expected
    ]
    return counts.select(F.inline(F.array(*rows)))


def numeric_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in cols if isinstance(kinds[c], T.NumericType)]


def forecast_long_form(df: DataFrame, covariates: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    """unique_id, ds, y and covariates, rows without NULLs."""
    return df.select(
        F.col("LCLid").alias("unique_id"), F.col("day").alias("ds"), F.col(target).alias("y"), *covariates
    ).na.drop()
