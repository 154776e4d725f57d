"""What drives a prediction: contributions in long form and their rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DAY, ID
from ..session import with_scalars
from .quantiles import rank_values


def contributions(
    df: DataFrame, coefs: Mapping[str, float], intercept: float = 0.0, keys: Sequence[str] = (ID, DAY)
) -> DataFrame:
    """Exact Shapley values of a linear model for every row: coef * (x - mean x).

    keys, feature, feature_value, contribution, base_value. One aggregate for the means, one
    pass for the rows; no sampling.
    """
    means = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in coefs])
    base = sum((F.lit(float(b)) * F.col(f"__m_{c}") for c, b in coefs.items()), F.lit(float(intercept)))
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).cast("double").alias("feature_value"),
            (F.lit(float(b)) * (F.col(c) - F.col(f"__m_{c}"))).alias("contribution"),
        )
        for c, b in coefs.items()
    ]
    return with_scalars(df, means.withColumn("base_value", base)).select(
        *keys, "base_value", F.inline(F.array(*rows))
    )


def importance_rank(df: DataFrame, value: str, name: str = "feature", share: str = "contribution_pct") -> DataFrame:
    """Rank 1..n by value and share in %. One row per feature, so the window is small."""
    w = Window.partitionBy(F.lit(0))
    return df.withColumn(
        "rank", F.row_number().over(w.orderBy(F.desc(value), name))
    ).withColumn(share, F.col(value) / F.sum(value).over(w) * 100)


def global_driver_ranking(contrib: DataFrame, top_k: int | None = None) -> DataFrame:
    mean = contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
    ranked = importance_rank(mean, "importance")
    return ranked.where(F.col("rank") <= top_k) if top_k else ranked


def group_importance(contrib: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Mean |contribution| within each group. contribution_pct compares it with the overall
    mean and can exceed 100; share_pct is the group's part of the whole."""
    per = contrib.groupBy("feature").agg(
        F.sum(F.abs("contribution")).alias("s"), F.count("contribution").alias("n")
    )
    named = [F.struct(F.lit(g).alias("group"), F.lit(c).alias("__f")) for g, cs in groups.items() for c in cs]
    pairs = contrib.sparkSession.range(1).select(F.inline(F.array(*named)))
    overall = per.agg(F.sum("s").alias("__s"), F.sum("n").alias("__n"))
    by_group = (
        per.join(F.broadcast(pairs), F.col("feature") == F.col("__f"))
        .groupBy("group")
        .agg(
            (F.sum("s") / F.sum("n")).alias("importance"),
            F.count("feature").alias("feature_count"),
            F.sum("s").alias("__g"),
        )
    )
    out = with_scalars(by_group, overall).select(
        "group",
        "importance",
        (F.col("importance") / (F.col("__s") / F.col("__n")) * 100).alias("contribution_pct"),
        (F.col("__g") / F.col("__s") * 100).alias("share_pct"),
        "feature_count",
        (F.col("importance") / F.col("feature_count")).alias("avg_per_feature"),
    )
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "group")
    return out.withColumn("rank", F.row_number().over(w))


def local_insights(
    contrib: DataFrame, k: int = 3, top: int = 5, keys: Sequence[str] = (ID, DAY)
) -> DataFrame:
    """k rows at evenly spaced positions of the key order, with their strongest pushes.

    The distinct keys are counted by the first key (the household, which has at most one row per
    day), and the households are ranked by bins (rank_values): their counts tell in which k of them
    the positions lie. Only those households' rows are ordered.
    """
    keys = list(keys)
    first, rest = keys[0], keys[1:]
    ranked = rank_values(contrib.select(*keys).distinct(), [first])
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") - 1) / max(k - 1, 1)))
    held = ranked.select(F.col(first).alias("__first"), "c", "below", picks.alias("__picks"))
    held = held.where(F.exists("__picks", lambda p: (p >= F.col("below")) & (p < F.col("below") + F.col("c"))))
    near = contrib.join(F.broadcast(held), F.col(first).eqNullSafe(F.col("__first")))
    place = F.dense_rank().over(Window.partitionBy(first).orderBy(*rest)) if rest else F.lit(1)
    local = near.withColumn("__at", F.col("below") + place - 1).where(F.array_contains("__picks", F.col("__at")))
    local = local.na.drop(subset=keys)  # a key that is not known names no row
    w = Window.partitionBy(*keys)
    up, down = w.orderBy(F.desc("contribution"), "feature"), w.orderBy("contribution", "feature")
    impact = F.sum("contribution").over(w)
    return (
        local.select(
            *keys,
            "feature",
            "feature_value",
            "contribution",
            F.row_number().over(up).alias("rank_up"),
            F.row_number().over(down).alias("rank_down"),
            impact.alias("total_impact"),
            (F.col("base_value") + impact).alias("predicted"),
        )
        .where((F.col("rank_up") <= top) | (F.col("rank_down") <= top))
    )


def contributions_by_cluster(contrib: DataFrame, cluster: str = "cluster") -> DataFrame:
    return contrib.groupBy(cluster, "feature").agg(
        F.avg(F.abs("contribution")).alias("importance"), F.avg("contribution").alias("mean_contribution")
    )


def dependence_points(
    contrib: DataFrame, feature: str, interaction: str, keys: Sequence[str] = (ID, DAY)
) -> DataFrame:
    """(value, contribution) of one feature with the value of another, by row."""

    def of(f: str, c: str):
        return F.max(F.when(F.col("feature") == f, F.col(c)))

    return (
        contrib.where(F.col("feature").isin(feature, interaction))
        .groupBy(*keys)
        .agg(
            of(feature, "feature_value").alias("feature_value"),
            of(feature, "contribution").alias("contribution"),
            of(interaction, "feature_value").alias("interaction_value"),
        )
    )
