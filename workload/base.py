"""Query registry: each entry holds a Spark callable and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import half_way_shift, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register `fn(fixtures) -> DataFrame`. Doubles are rounded on both sides: in Spark by
    type, in SQL by R(x), which the twin's text writes as {{x}}."""

    def add(fn):
        assert name not in QUERIES, name

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from .fixtures import Fixtures

            return rounded(fn(Fixtures(spark, sf_dir)), digits)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_ctes(sql, digits)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to `digits` places; -0.0 becomes 0.0.

    A value half way between two roundings (an average of 64 readings can be one) would go up
    or down with the order of summation, so both engines add the same small shift first.
    """
    return df.select(
        *[
            (F.round(F.col(f"`{c}`") + F.lit(half_way_shift(digits)), digits) + F.lit(0.0)).alias(c)
            if t == "double"
            else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )
