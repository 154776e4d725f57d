"""Load-archetype analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.operators import clean, clusters
from wattloom.plans import training
from wattloom.schema import ID

from .base import query
from .q_analytics import _FIVE


@query("kmeans_load_shapes")
def _(fx):
    labels, score = training.kmeans_load_shapes(fx.supplier_profiles(), k=3)
    return labels.withColumn("silhouette", F.lit(float(score)))


@query("kmeans_vectors")
def _(fx):
    labels, score = training.kmeans_vectors(fx.table("embeddings"), "vec_id", "embedding", k=8)
    return labels.withColumn("silhouette", F.lit(float(score)))


@query(
    "cluster_profile_summary",
    """SELECT cluster, (round(avg(total_kwh), 2) + 0e0) AS total_kwh_mean, (round(stddev_samp(total_kwh), 2) + 0e0) AS total_kwh_std,
    (round(avg(peak_hour), 2) + 0e0) AS peak_hour_mean, arg_min(peak_hour, (-n_peak, peak_hour)) AS peak_hour_mode,
    arg_min("stdorToU", (-n_tariff, "stdorToU")) AS tariff_mode, arg_min("Acorn_grouped", (-n_acorn, "Acorn_grouped")) AS acorn_mode,
    (round(avg(std_kwh), 2) + 0e0) AS variability_mean FROM (SELECT *, count(*) OVER (PARTITION BY cluster, peak_hour) AS n_peak,
      count(*) OVER (PARTITION BY cluster, "stdorToU") AS n_tariff, count(*) OVER (PARTITION BY cluster, "Acorn_grouped") AS n_acorn FROM pcal) GROUP BY 1""",
)
def _(fx):
    return clusters.cluster_profile_summary(fx.profile_features())


_FIRST = """(SELECT "LCLid", arg_min(cluster, day) AS cluster FROM clusters GROUP BY 1)"""


@query(
    "cluster_size",
    f"""SELECT cluster, count(*) AS households, {{{{count(*) / sum(count(*)) OVER () * 100}}}} AS pct FROM {_FIRST} GROUP BY 1""",
)
def _(fx):
    return clusters.cluster_size(fx.clusters())


@query(
    "acorn_share_by_cluster",
    f"""SELECT cluster, "Acorn_grouped", count(*) AS rows, {{{{count(*) / sum(count(*)) OVER (PARTITION BY cluster) * 100}}}} AS pct
    FROM {_FIRST} f JOIN household h ON f."LCLid" = h."LCLid" GROUP BY 1, 2""",
)
def _(fx):
    df = clean.join_household(fx.clusters(), fx.household())
    return clusters.acorn_share_by_cluster(df)


_SW = """(SELECT "LCLid", count(*) AS total_days, sum(moved)::bigint AS switches, sum(moved) / (count(*) - 1)::double AS switch_rate FROM
    (SELECT "LCLid", CASE WHEN p IS NULL THEN {first} ELSE (p <> cluster)::int END AS moved FROM
      (SELECT *, lag(cluster) OVER (PARTITION BY "LCLid" ORDER BY day) AS p FROM clusters)) GROUP BY 1 HAVING count(*) > 1)"""


@query("cluster_switching", f'SELECT "LCLid", switches, total_days, {{{{switch_rate}}}} AS switch_rate FROM {_SW.format(first=0)}')
def _(fx):
    return clusters.cluster_switching(fx.clusters())


@query("cluster_switching_count_first", f'SELECT "LCLid", switches, total_days, {{{{switch_rate}}}} AS switch_rate FROM {_SW.format(first=1)}')
def _(fx):
    return clusters.cluster_switching(fx.clusters(), count_first=True)


@query(
    "switch_summary",
    f"""SELECT {{{{avg(switch_rate)}}}} AS mean_rate, {{{{quantile_cont(switch_rate, 0.5)}}}} AS median_rate, {{{{avg((switch_rate < 0.1)::int) * 100}}}} AS stable_pct,
    {{{{avg((switch_rate > 0.5)::int) * 100}}}} AS volatile_pct FROM {_SW.format(first=0)}""",
)
def _(fx):
    return clusters.switch_summary(clusters.cluster_switching(fx.clusters()))


@query(
    "switch_rate_by_acorn",
    f"""SELECT "Acorn_grouped", count(*) AS n, {_FIVE.format(v="switch_rate")} FROM {_SW.format(first=0)} s JOIN household h ON s."LCLid" = h."LCLid" GROUP BY 1""",
)
def _(fx):
    return clusters.five_number_by_dim(clusters.cluster_switching(fx.clusters()), "switch_rate", fx.household(), "Acorn_grouped")


_ST = """(SELECT "LCLid", arg_min(cluster, (-n, cluster)) AS dominant_cluster, max(n) / any_value(total) AS dominant_proportion,
    CASE WHEN count(*) = 1 THEN 0e0 ELSE -sum(n / total * log2(n / total)) END AS entropy,
    1 - CASE WHEN count(*) = 1 THEN 0e0 ELSE -sum(n / total * log2(n / total)) / log2(count(*)) END AS stability_score FROM
    (SELECT "LCLid", cluster, count(*)::double AS n, sum(count(*)) OVER (PARTITION BY "LCLid")::double AS total FROM clusters GROUP BY 1, 2) GROUP BY 1 HAVING any_value(total) > 1)"""


@query(
    "cluster_stability",
    f"""SELECT s."LCLid", dominant_cluster, {{{{dominant_proportion}}}} AS dominant_proportion, {{{{entropy}}}} AS entropy, {{{{stability_score}}}} AS stability_score,
    month_count::int AS month_count FROM {_ST} s JOIN (SELECT "LCLid", count(DISTINCT date_trunc('month', day)) AS month_count FROM clusters GROUP BY 1) m ON s."LCLid" = m."LCLid" """,
)
def _(fx):
    return clusters.cluster_stability(fx.clusters())


@query(
    "stability_by_acorn",
    f"""SELECT "Acorn_grouped", count(*) AS n, {_FIVE.format(v="stability_score")} FROM {_ST} s JOIN household h ON s."LCLid" = h."LCLid" GROUP BY 1""",
)
def _(fx):
    return clusters.five_number_by_dim(clusters.cluster_stability(fx.clusters()), "stability_score", fx.household(), "Acorn_grouped")


@query(
    "stability_vs_consumption",
    f"""SELECT s."LCLid", {{{{stability_score}}}} AS stability_score, {{{{mean_kwh}}}} AS mean_kwh FROM {_ST} s
    JOIN (SELECT "LCLid", avg(total_kwh) AS mean_kwh FROM meter GROUP BY 1) m ON s."LCLid" = m."LCLid" """,
)
def _(fx):
    df = clusters.stability_vs_consumption(clusters.cluster_stability(fx.clusters()), fx.meter())
    return df.select(ID, "stability_score", "mean_kwh")


@query("stability_by_dominant", f"SELECT dominant_cluster, count(*) AS n, {_FIVE.format(v='stability_score')} FROM {_ST} GROUP BY 1")
def _(fx):
    return clusters.stability_by_dominant(clusters.cluster_stability(fx.clusters()))


@query(
    "most_volatile",
    f"""SELECT c."LCLid", c.day, c.cluster, {{{{switch_rate}}}} AS switch_rate FROM clusters c JOIN (SELECT "LCLid", switch_rate FROM {_SW.format(first=0)}
    ORDER BY switch_rate DESC, "LCLid" LIMIT 5) t ON c."LCLid" = t."LCLid" """,
)
def _(fx):
    c = fx.clusters()
    return clusters.most_volatile(c, clusters.cluster_switching(c))


@query(
    "cluster_share_by_month",
    "SELECT date_trunc('month', day)::date AS month_period, "
    + ", ".join(f'{{{{count(*) FILTER (cluster = {c}) / count(*)}}}} AS "{c}"' for c in range(3))
    + " FROM clusters GROUP BY 1",
)
def _(fx):
    return clusters.cluster_share_by_month(fx.clusters(), [0, 1, 2])


@query(
    "welch_ttest",
    f"""WITH s AS (SELECT "Acorn_grouped" AS g, count(*)::double AS n, avg(stability_score) AS m, var_samp(stability_score) AS v, row_number() OVER (ORDER BY count(*) DESC, "Acorn_grouped") AS k
      FROM {_ST} x JOIN household h ON x."LCLid" = h."LCLid" GROUP BY 1)
    SELECT a.g AS group_1, b.g AS group_2, {{{{(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)}}}} AS t,
    {{{{(a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1))}}}} AS dof FROM s a, s b WHERE a.k = 1 AND b.k = 2""",
    digits=4,
)
def _(fx):
    st = clean.join_stats_to_dim(clusters.cluster_stability(fx.clusters()), fx.household(), ["Acorn_grouped"])
    return clusters.welch_ttest(st, "stability_score", "Acorn_grouped").drop("p_value")


@query("welch_ttest_p")
def _(fx):
    st = clean.join_stats_to_dim(clusters.cluster_stability(fx.clusters()), fx.household(), ["Acorn_grouped"])
    return clusters.welch_ttest(st, "stability_score", "Acorn_grouped")


@query(
    "longest_households",
    """SELECT m."LCLid", m.day, {{total_kwh}} AS total_kwh, days FROM meter m JOIN (SELECT "LCLid", count(DISTINCT day) AS days FROM meter GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 2) t ON m."LCLid" = t."LCLid" """,
)
def _(fx):
    from wattloom.operators.analytics import longest_households

    return longest_households(fx.meter())
