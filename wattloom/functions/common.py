"""Column helpers shared by the feature functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """0/1 flag; an unknown comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """Division whose zero denominator gives NULL (also under ANSI mode)."""
    return F.try_divide(num, den)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`, also inside array lambdas."""
    return F.transform(F.array(value), body)[0]


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def pick(cols: Iterable[str], prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in cols]


def masked_corr(x: str, y: str, over=None) -> Column:
    """Pearson r over the pairs with both values; NULL for a constant side or one pair.

    Built from moments, since corr() raises on a constant column under ANSI mode. With
    `over` the moments are window aggregates.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    cx, cy = F.when(both, F.col(x)), F.when(both, F.col(y))
    moments = [F.covar_pop(cx, cy), F.stddev_pop(cx), F.stddev_pop(cy)]
    if over is not None:
        moments = [m.over(over) for m in moments]
    cov, sx, sy = moments
    return ratio(cov, sx * sy)


def rows() -> Column:
    """count(*)."""
    return F.count(F.lit(1))
