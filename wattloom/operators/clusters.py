"""Analytics on load-archetype labels: profiles, switching and stability."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import ratio, rows
from ..schema import DAY, ID
from .clean import join_stats_to_dim
from .panel import by_day
from .quantiles import five_number, quantiles



def cluster_profile_summary(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean / sample std of use, peak slot mean and mode, modal tariff and group, mean
    variability; optional columns are used when present. Modes have few distinct values."""
    have = set(df.columns)
    aggs = [
        F.round(F.avg("total_kwh"), 2).alias("total_kwh_mean"),
        F.round(F.stddev_samp("total_kwh"), 2).alias("total_kwh_std"),
    ]
    if "peak_hour" in have:
        aggs += [
            F.round(F.avg("peak_hour"), 2).alias("peak_hour_mean"),
            F.mode("peak_hour", True).alias("peak_hour_mode"),
        ]
    for c, out in (("stdorToU", "tariff_mode"), ("Acorn_grouped", "acorn_mode")):
        if c in have:
            aggs.append(F.mode(c, True).alias(out))
    if "daily_variability" in have:
        aggs.append(F.round(F.avg("daily_variability"), 2).alias("variability_mean"))
    known = F.col(cluster).isNotNull() & F.col("total_kwh").isNotNull()
    return df.where(known).groupBy(cluster).agg(*aggs)


def first_day_rows(df: DataFrame, cluster: str, attrs: Sequence[str] = ()) -> DataFrame:
    """One row per household: its cluster on the first day, with household attributes.

    The readings are reduced by a hash aggregate on fixed-width buffers (day and cluster
    number); attributes are grouping keys, because text in a buffer would force a sort. Only
    the reduced rows, about one per household, go through the struct minimum.
    """
    per = df.groupBy(ID, *attrs).agg(F.min(DAY).alias("d"), F.min_by(cluster, DAY).alias("c"))
    if not attrs:
        return per.select(ID, F.col("c").alias(cluster))
    one = per.groupBy(ID).agg(F.min(F.struct("d", "c", *attrs)).alias("s"))
    return one.select(ID, F.col("s.c").alias(cluster), *[F.col(f"s.{a}").alias(a) for a in attrs])


def cluster_size(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    n = first_day_rows(df, cluster).groupBy(cluster).agg(rows().alias("households"))
    total = F.sum("households").over(Window.partitionBy(F.lit(0)))  # one row per cluster
    return n.withColumn("pct", F.col("households") / total * 100)


def acorn_share_by_cluster(df: DataFrame, cluster: str = "cluster", group: str = "Acorn_grouped") -> DataFrame:
    from .analytics import crosstab_row_pct

    one = first_day_rows(df, cluster, [group]).na.drop(subset=[cluster, group])
    return crosstab_row_pct(one, cluster, group)


def cluster_switching(df: DataFrame, cluster: str = "cluster", count_first: bool = False) -> DataFrame:
    """switches, total_days and switches / (days - 1) per household with over one row.

    count_first=True also counts the first row as a switch, as the published figures do.
    """
    known = df.select(ID, DAY, cluster).na.drop()
    prev = F.lag(cluster).over(by_day())
    moved = F.when(prev.isNull(), int(count_first)).otherwise((F.col(cluster) != prev).cast("int"))
    return (
        known.withColumn("__moved", moved)
        .groupBy(ID)
        .agg(F.sum("__moved").alias("switches"), rows().alias("total_days"))
        .where("total_days > 1")
        .withColumn("switch_rate", F.col("switches") / (F.col("total_days") - 1))
    )


def switch_summary(switching: DataFrame, approx: bool = False) -> DataFrame:
    rate = F.col("switch_rate")
    basic = switching.agg(
        F.avg(rate).alias("mean_rate"),
        (F.avg((rate < 0.1).cast("int")) * 100).alias("stable_pct"),
        (F.avg((rate > 0.5).cast("int")) * 100).alias("volatile_pct"),
    )
    med = quantiles(switching, "switch_rate", [0.5], approx=approx).select(F.col("q")[0].alias("median_rate"))
    return basic.crossJoin(F.broadcast(med))


def five_number_by_dim(
    stats: DataFrame, value: str, dim: DataFrame, col: str, approx: bool = False
) -> DataFrame:
    """Box statistics of a per-household figure by a household attribute."""
    joined = join_stats_to_dim(stats, dim, [col]).where(F.col(col).isNotNull())
    return five_number(joined, value, [col], approx=approx)


def most_volatile(df: DataFrame, switching: DataFrame, top: int = 5, cluster: str = "cluster") -> DataFrame:
    """Timelines of the households that switch most."""
    ids = switching.orderBy(F.desc("switch_rate"), ID).limit(top).select(ID, "switch_rate")
    return df.select(ID, DAY, cluster).join(F.broadcast(ids), ID).orderBy(ID, DAY)


def cluster_share_by_month(df: DataFrame, clusters: Sequence, cluster: str = "cluster") -> DataFrame:
    """Share of household-days per month, one column per cluster (0 where absent)."""
    counts = (
        df.where(F.col(cluster).isNotNull())
        .groupBy(F.trunc(DAY, "MM").alias("month_period"))
        .pivot(cluster, list(clusters))
        .agg(rows())
        .na.fill(0)
    )
    total = sum((F.col(str(c)) for c in clusters), F.lit(0))
    return counts.select("month_period", *[(F.col(str(c)) / total).alias(str(c)) for c in clusters])


def cluster_stability(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Dominant cluster and its share, entropy in bits, 1 - normalised entropy and months.

    The readings are counted by household, cluster and month in a hash aggregate; what
    follows sees only those counts.
    """
    known = df.select(ID, F.trunc(DAY, "MM").alias("month"), cluster).na.drop()
    monthly = known.groupBy(ID, cluster, "month").agg(rows().alias("n"))
    per = monthly.groupBy(ID, cluster).agg(F.sum("n").alias("n"), F.collect_list("month").alias("months"))
    agg = per.groupBy(ID).agg(
        F.sum("n").alias("total"),
        rows().alias("kinds"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col(cluster).alias("c"))).alias("top"),
        F.sum(F.col("n") * F.log2("n")).alias("nlogn"),
        F.size(F.array_distinct(F.flatten(F.collect_list("months")))).alias("month_count"),
    )
    entropy = F.when(F.col("kinds") == 1, 0.0).otherwise(F.log2("total") - F.col("nlogn") / F.col("total"))
    norm = F.when(F.col("kinds") == 1, 0.0).otherwise(entropy / F.log2("kinds"))
    return agg.where("total > 1").select(
        ID,
        F.col("top.c").alias("dominant_cluster"),
        (-F.col("top.neg") / F.col("total")).alias("dominant_proportion"),
        entropy.alias("entropy"),
        (1 - norm).alias("stability_score"),
        "month_count",
    )


def stability_vs_consumption(stability: DataFrame, df: DataFrame, value: str = "total_kwh") -> DataFrame:
    means = df.groupBy(ID).agg(F.avg(value).alias("mean_kwh"))
    return stability.join(means, ID)


def stability_by_dominant(stability: DataFrame, approx: bool = False) -> DataFrame:
    return five_number(stability, "stability_score", ["dominant_cluster"], approx=approx)


# --- Welch's test ------------------------------------------------------------------


def t_two_sided_p(t: Column, dof: Column, steps: int = 4000) -> Column:
    """Two-sided p of Student's t as a ratio of two integrals.

    With t = sqrt(dof) * tan(angle) the density becomes cos(angle) ** (dof - 1), so no gamma
    function is needed. Simpson's rule runs over an array of grid points in the row; the upper
    end follows the density's width, which shrinks as 1 / sqrt(dof).
    """

    def area(lo: Column, hi: Column) -> Column:
        h = (hi - lo) / steps

        def term(i: Column) -> Column:
            w = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            c = F.greatest(F.cos(lo + i * h), F.lit(1e-300))
            return w * F.exp((dof - 1) * F.log(c))

        grid = F.transform(F.sequence(F.lit(0), F.lit(steps)), term)
        return h / 3 * F.aggregate(grid, F.lit(0.0), lambda a, x: a + x)

    top = F.least(F.lit(math.pi / 2), F.lit(40.0) / F.sqrt(dof))
    start = F.least(F.atan(F.abs(t) / F.sqrt(dof)), top)
    return ratio(area(start, top), area(F.lit(0.0), top))


def welch_ttest(df: DataFrame, value: str, group: str) -> DataFrame:
    """t, degrees of freedom and p between the two largest groups (ties by name).

    One aggregate gives n, mean and variance per group; the rest is arithmetic on two rows.
    """
    v = F.col(value)
    top = (
        df.where(F.col(group).isNotNull() & v.isNotNull())
        .groupBy(group)
        .agg(rows().alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s2"))
        .orderBy(F.desc("n"), group)
        .limit(2)
    )
    pair = top.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(group).alias("g"), "n", "m", "s2"))).alias("p")
    ).where(F.size("p") == 2)
    a, b = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    va, vb = a["s2"] / a["n"], b["s2"] / b["n"]
    t = ratio(a["m"] - b["m"], F.sqrt(va + vb))
    dof = ratio((va + vb) * (va + vb), va * va / (a["n"] - 1) + vb * vb / (b["n"] - 1))
    out = pair.select(a["g"].alias("group_1"), b["g"].alias("group_2"), t.alias("t"), dof.alias("dof"))
    return out.withColumn("p_value", t_two_sided_p(F.col("t"), F.col("dof")))
