"""Exact quantiles and ranks that no single task has to hold.

percentile() keeps every distinct value of a group in one aggregation buffer and a window
without keys sorts the table in one task. Here the values are first counted (map-side
combined), then cut into ordered bins. Bin totals, at most one per bin and key, give each bin's
starting rank, and only inside a bin are values sorted. A key with a third of all rows is
spread over the bins, so its work is shared.

Bin edges are the values whose hash is smallest: a uniform sample of the distinct
values that comes out the same whenever a lost task is run again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import with_scalars

MIN_BINS, MAX_BINS = 64, 1024
HEAVY = 1000  # a value with this share of the rows is heavy


def _bin_count(df: DataFrame) -> int:
    """As many bins as shuffle partitions, within limits that keep the edge array small."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_BINS, min(parts, MAX_BINS))


def _binned(hist: DataFrame, count: str, order: Column, seed_cols: Sequence[str], bins: int) -> DataFrame:
    """Add __bin, the number of edges at or below `order`.

    The filter on the count is always true. It keeps the count in both uses of `hist`, so
    they have the same plan and Spark runs the counting once (ReusedExchange).
    """
    edges = (
        hist.where(F.col(count) > 0)
        .select(order.alias("__o"), F.xxhash64(*seed_cols).alias("__h"))
        .orderBy("__h", "__o")
        .limit(bins - 1)
        .agg(F.sort_array(F.array_distinct(F.collect_list("__o"))).alias("__edges"))
    )
    # two short searches: every step-th edge, then the edges between two of those
    step = max(2, math.isqrt(bins))
    coarse = F.filter("__edges", lambda e, i: (i + 1) % step == 0)
    edges = edges.select("__edges", coarse.alias("__coarse"))

    def up_to(a: Column) -> Column:
        return F.size(F.filter(a, lambda e: e <= order))

    full = up_to(F.col("__coarse")) * step
    return (
        with_scalars(hist, edges)
        .withColumn("__full", full)
        .withColumn("__bin", F.col("__full") + up_to(F.slice("__edges", F.col("__full") + 1, step)))
        .drop("__edges", "__coarse", "__full")
    )


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be NULL.

    Joined by bin alone, `right` has at most one row per bin and is broadcast, so values of
    bins that are not wanted leave before the exchange.
    """
    if len(keys) == 1:
        right = F.broadcast(right)
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond).drop(*[f"__r_{k}" for k in keys])


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    approx: bool = False,
    accuracy: int = 10_000,
    bins: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """keys, n, q: array of linear-interpolation quantiles in the order of `probs`.

    NULL values are left out. approx=True takes Spark's mergeable sketch in one shuffle. `weight` is
    a column of counts: a row stands for so many equal ones.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    many = F.sum(weight) if weight else F.count(F.lit(1))
    if approx and not weight:
        p = F.array(*[F.lit(float(x)) for x in probs])
        return (
            df.where(v.isNotNull())
            .groupBy(*keys)
            .agg(many.alias("n"), F.percentile_approx(v, p, F.lit(accuracy)).alias("q"))
        )
    hist = df.where(v.isNotNull()).groupBy(*keys, v.alias("__v")).agg(many.alias("__c"))
    binned = _binned(hist, "__c", F.col("__v"), [*keys, "__v"], bins or _bin_count(df))

    # <= `bins` rows per key from here to `hits`
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    totals = (
        binned.groupBy(*keys, "__bin")
        .agg(F.sum("__c").alias("__bc"))
        .select(
            *keys,
            "__bin",
            "__bc",
            (F.sum("__bc").over(per_key.orderBy("__bin")) - F.col("__bc")).alias("__start"),
            F.sum("__bc").over(per_key).alias("n"),
        )
    )
    pos = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.array(*[f(x).cast("long") for x in pos for f in (F.floor, F.ceil)])
    end = F.col("__start") + F.col("__bc")
    hits = totals.where(F.exists(ranks, lambda r: (r >= F.col("__start")) & (r < end))).select(
        *keys, "__bin", "__start", "n"
    )

    # only the bins that hold a wanted rank are ordered
    inside = Window.partitionBy(*keys, "__bin").orderBy("__v")
    ranked = _on(binned, hits, [*keys, "__bin"]).withColumn(
        "__to", F.col("__start") + F.sum("__c").over(inside)
    )
    aggs = [F.first("n").alias("n")]
    for i, x in enumerate(pos):
        for f, tag in ((F.floor, "lo"), (F.ceil, "hi")):
            r = f(x).cast("long")
            at = (r >= F.col("__to") - F.col("__c")) & (r < F.col("__to"))
            aggs.append(F.max(F.when(at, F.col("__v"))).alias(f"__{tag}{i}"))
    found = ranked.groupBy(*keys).agg(*aggs)
    blend = [
        F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (x - F.floor(x))
        for i, x in enumerate(pos)
    ]
    return found.select(*keys, "n", F.array(*blend).alias("q"))


def rank_values(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), bins: int | None = None
) -> DataFrame:
    """Distinct `cols` per key with their place in the ascending order.

    keys, cols, c (rows with this value), code (distinct values below), below (rows below),
    n (rows of the key).
    """
    cols, keys = list(cols), list(keys)
    hist = df.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("c"))
    order = F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)
    binned = _binned(hist, "c", order, [*keys, *cols], bins or _bin_count(df))
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    run = per_key.orderBy("__bin")
    starts = (
        binned.groupBy(*keys, "__bin")
        .agg(F.sum("c").alias("__bc"), F.count(F.lit(1)).alias("__bd"))
        .select(
            *keys,
            "__bin",
            (F.sum("__bc").over(run) - F.col("__bc")).alias("__row0"),
            (F.sum("__bd").over(run) - F.col("__bd")).alias("__code0"),
            F.sum("__bc").over(per_key).alias("n"),
        )
    )
    inside = Window.partitionBy(*keys, "__bin").orderBy(*cols)
    return _on(binned, starts, [*keys, "__bin"]).select(
        *keys,
        *cols,
        "c",
        (F.col("__code0") + F.row_number().over(inside) - 1).cast("long").alias("code"),
        (F.col("__row0") + F.sum("c").over(inside) - F.col("c")).cast("long").alias("below"),
        "n",
    )


def pct_rank_true(df: DataFrame, value: str, out: str = "pct_true_rank") -> DataFrame:
    """Average-tie percentile rank x 100 of `value` over the whole table; NULL has no rank.

    A value that holds a thousandth of the rows or more is one of a thousand at most: those are
    broadcast. Rows with the others are joined on the value, so no task gets more than a thousandth
    of all rows for one value; rows that need no partner there, heavy or NULL, are spread by a salt
    that finds none.
    """
    r = rank_values(df.where(F.col(value).isNotNull()), [value])
    rank = (F.col("below") + (F.col("c") + 1) / 2) / F.col("n") * 100
    heavy = F.col("c") * HEAVY >= F.col("n")
    ranked = r.select(F.col(value).alias("__v"), rank.alias("__r"), heavy.alias("__heavy"))
    many = ranked.where("__heavy").select(F.col("__v").alias("__hv"), F.col("__r").alias("__hr"))
    few = ranked.where("not __heavy").select(F.struct(F.col("__v").alias("v"), F.lit(0).cast("bigint").alias("s")).alias("__key"), "__r")
    own = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    out_of_join = F.col("__hr").isNotNull() | F.col(value).isNull()
    rows = df.join(F.broadcast(many), F.col(value) == F.col("__hv"), "left")
    salt = F.when(out_of_join, F.pmod(own, F.lit(1 << 20)) + 1).otherwise(0).cast("bigint")
    # one key of two parts: apart, the constant part would leave the exchange
    rows = rows.withColumn("__salted", F.struct(F.col(value).alias("v"), salt.alias("s")))
    found = rows.join(few, F.col("__salted") == F.col("__key"), "left")
    return found.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("__hr", "__r").alias(out))


def five_number(
    df: DataFrame, value: str, keys: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """Box-plot statistics of `value` by keys."""
    names = ["min", "q1", "median", "q3", "max"]
    q = quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0], keys, approx=approx)
    return q.select(*keys, "n", *[F.col("q")[i].alias(x) for i, x in enumerate(names)])
