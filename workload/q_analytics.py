"""Quality counts, curves, distributions, crosstabs, bins, trends and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions import calendar as cal
from wattloom.operators import analytics as an
from wattloom.operators import anomalies as no
from wattloom.operators import panel, quantiles
from wattloom.schema import DAY, ID
from wattloom.sources import readers

from .base import query

_NULLABLE = ["temperatureMax", "humidity", "holiday_type", "Acorn"]


@query(
    "null_counts",
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (\"{c}\" IS NULL) AS nulls FROM merged" for c in _NULLABLE)
    + ") WHERE nulls > 0",
)
def _(fx):
    return an.null_counts(fx.merged(), _NULLABLE)


@query(
    "duplicate_keys",
    """SELECT sum(n - 1)::bigint AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, cast(l_shipdate AS date))""",
)
def _(fx):
    df = fx.table("lineitem").select("l_suppkey", F.to_date("l_shipdate").alias(DAY))
    return an.duplicate_keys(df, ["l_suppkey", DAY])


@query("date_range", "SELECT min(day) AS first_day, max(day) AS last_day FROM meter")
def _(fx):
    return an.date_range(fx.meter())


@query(
    "household_coverage",
    """SELECT {{min(n)}} AS min, {{quantile_cont(n, 0.5)}} AS median, {{max(n)}} AS max FROM (SELECT count(DISTINCT day) AS n FROM meter GROUP BY "LCLid")""",
)
def _(fx):
    return an.household_coverage(fx.meter())


@query("active_households_per_day", 'SELECT day, count(DISTINCT "LCLid") AS households FROM meter GROUP BY 1')
def _(fx):
    return an.active_households_per_day(fx.meter())


_FIVE = """{{{{quantile_cont({v}, 0.0)}}}} AS min, {{{{quantile_cont({v}, 0.25)}}}} AS q1, {{{{quantile_cont({v}, 0.5)}}}} AS median,
    {{{{quantile_cont({v}, 0.75)}}}} AS q3, {{{{quantile_cont({v}, 1.0)}}}} AS max"""


@query("describe_total", f"SELECT count(total_kwh) AS count, {{{{avg(total_kwh)}}}} AS mean, {{{{stddev_samp(total_kwh)}}}} AS std, {_FIVE.format(v='total_kwh')} FROM meter")
def _(fx):
    return an.describe_total(fx.meter())


@query(
    "histogram_total",
    """SELECT bin, {{lo + bin * w}} AS bin_start, count(*) AS rows FROM (SELECT least(floor((total_kwh - lo) / w), 99)::int AS bin, lo, w FROM meter,
    (SELECT min(total_kwh) AS lo, (max(total_kwh) - min(total_kwh)) / 100 AS w FROM meter)) GROUP BY bin, lo, w""",
)
def _(fx):
    return an.histogram(fx.meter())


# --- load curves ------------------------------------------------------------------------


def _curve(keys: str, where: str = "") -> str:
    names = [k.split(" AS ")[-1] for k in keys.split("; ")] if keys else []
    cols = ", ".join(keys.split("; ")) + ", " if keys else ""
    by = ", ".join(names + ["slot"])
    return f"""SELECT {cols}slot, {{{{avg(x)}}}} AS mean_kwh FROM pclean c JOIN pcal p ON c."LCLid" = p."LCLid" AND c.day = p.day {where} GROUP BY {by}"""


def _c(df):
    return df.withColumn("slot", F.col("slot").cast("int"))


@query("load_curve_overall", "SELECT slot, {{avg(x)}} AS mean_kwh FROM pclean GROUP BY 1")
def _(fx):
    return _c(an.load_curve(fx.profiles()))


@query("load_curve_by_daytype", _curve("is_weekend"))
def _(fx):
    return _c(an.load_curve(cal.calendar_basic(fx.profiles()), ["is_weekend"]))


@query("load_curve_by_season", _curve("season"))
def _(fx):
    return _c(an.load_curve(cal.season_of_month(cal.month_of_day(fx.profiles())), ["season"]))


@query("load_curve_by_cluster", _curve("cluster"))
def _(fx):
    return _c(an.load_curve(fx.profile_features(), ["cluster"]))


@query("load_curve_by_cluster_weekend", _curve("cluster; is_weekend"))
def _(fx):
    return _c(an.load_curve(fx.profile_features(), ["cluster", "is_weekend"]))


@query(
    "load_curve_modal_cluster_by_season",
    _curve("season", "WHERE cluster = (SELECT cluster FROM pcal GROUP BY 1 ORDER BY count(*) DESC, cluster LIMIT 1)"),
)
def _(fx):
    return _c(an.load_curve(an.top_k_groups(fx.profile_features(), "cluster", 1), ["season"]))


_BAND = """CASE WHEN {c} > -10 AND {c} <= 5 THEN 'Cold' WHEN {c} > 5 AND {c} <= 15 THEN 'Cool' WHEN {c} > 15 AND {c} <= 25 THEN 'Mild'
    WHEN {c} > 25 AND {c} <= 35 THEN 'Warm' END"""


@query("load_curve_by_temp_band", _curve(_BAND.format(c='"temperatureMax"') + " AS temp_band"))
def _(fx):
    return _c(an.load_curve(an.fixed_bins(fx.profile_features()), ["temp_band"]))


@query("load_curve_by_tariff", _curve('"stdorToU"'))
def _(fx):
    return _c(an.load_curve(fx.profile_features(), ["stdorToU"]))


@query(
    "peak_slot_histogram",
    """SELECT is_weekend, peak_hour, count(*) AS rows, {{count(*) / sum(count(*)) OVER (PARTITION BY is_weekend)}} AS share FROM pcal GROUP BY 1, 2""",
)
def _(fx):
    return an.peak_slot_histogram(fx.profile_features(), ["is_weekend"])


@query(
    "peak_slot_by_cluster",
    """SELECT cluster, peak_hour, count(*) AS rows, {{count(*) / sum(count(*)) OVER (PARTITION BY cluster)}} AS share FROM pcal GROUP BY 1, 2""",
)
def _(fx):
    return an.peak_slot_histogram(fx.profile_features(), ["cluster"])


# --- distributions ---------------------------------------------------------------------


def _five(src: str, v: str, keys: str) -> str:
    return f"SELECT {keys}, count({v}) AS n, {_FIVE.format(v=v)} FROM {src} WHERE {v} IS NOT NULL GROUP BY {keys}"


@query("five_number_by_acorn", _five("merged", "total_kwh", '"Acorn_grouped"'))
def _(fx):
    return quantiles.five_number(fx.merged(), "total_kwh", ["Acorn_grouped"])


@query("five_number_by_daytype", _five("(SELECT *, CASE WHEN is_holiday = 1 THEN 'Holiday' WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END AS day_type FROM cal)", "total_kwh", "day_type"))
def _(fx):
    return quantiles.five_number(cal.day_type(fx.calendar()), "total_kwh", ["day_type"])


@query("five_number_by_tariff", _five("pcal", "evening_kwh", '"stdorToU"'))
def _(fx):
    return quantiles.five_number(fx.profile_features(), "evening_kwh", ["stdorToU"])


@query("five_number_by_cluster", _five("pcal", "morning_kwh", "cluster"))
def _(fx):
    return quantiles.five_number(fx.profile_features(), "morning_kwh", ["cluster"])


@query("five_number_by_cluster_acorn", _five("fclusters", "total_kwh", 'cluster, "Acorn_grouped"'))
def _(fx):
    return quantiles.five_number(fx.feature_clusters(), "total_kwh", ["cluster", "Acorn_grouped"])


@query("five_number_by_cluster_tariff", _five("fclusters", "total_kwh", 'cluster, "stdorToU"'))
def _(fx):
    return quantiles.five_number(fx.feature_clusters(), "total_kwh", ["cluster", "stdorToU"])


@query("five_number_by_cluster_season", _five("fclusters", "total_kwh", "cluster, season"))
def _(fx):
    return quantiles.five_number(fx.feature_clusters(), "total_kwh", ["cluster", "season"])


@query("five_number_by_temp_band", _five(f"(SELECT *, {_BAND.format(c='temp_avg')} AS temp_band FROM fclusters)", "total_kwh", "cluster, temp_band"))
def _(fx):
    df = an.fixed_bins(fx.feature_clusters(), "temp_avg")
    return quantiles.five_number(df, "total_kwh", ["cluster", "temp_band"])


@query("five_number_ratio", _five("(SELECT *, (morning_kwh + afternoon_kwh) / nullif(evening_kwh + night_kwh, 0) AS r FROM pcal)", "r", "cluster"))
def _(fx):
    return quantiles.five_number(fx.profile_features(), "day_night_ratio", ["cluster"])


@query("five_number_variation", _five("(SELECT *, std_kwh / nullif(mean_kwh, 0) AS cv FROM pcal)", "cv", '"Acorn_grouped"'))
def _(fx):
    return quantiles.five_number(fx.profile_features(), "coefficient_of_variation", ["Acorn_grouped"])


@query(
    "mean_sd_peak_slot",
    """SELECT season, "stdorToU", {{avg(peak_hour)}} AS mean, {{stddev_samp(peak_hour)}} AS sd, count(peak_hour) AS n FROM pcal GROUP BY 1, 2""",
)
def _(fx):
    return an.mean_sd(fx.profile_features(), "peak_hour", ["season", "stdorToU"])


@query("weekday_average", """SELECT dayofweek, dayname(day) AS weekday_name, {{avg(total_kwh)}} AS mean_kwh FROM cal GROUP BY 1, 2""")
def _(fx):
    return an.weekday_average(cal.weekday_name(cal.calendar_basic(fx.meter())))


# --- crosstabs --------------------------------------------------------------------------


@query(
    "acorn_tariff_crosstab",
    """SELECT "Acorn_grouped", count(*) FILTER ("stdorToU" = 'Std') AS "Std", count(*) FILTER ("stdorToU" = 'ToU') AS "ToU" FROM merged GROUP BY 1""",
)
def _(fx):
    return an.crosstab(fx.merged(), "Acorn_grouped", "stdorToU", ["Std", "ToU"])


@query(
    "acorn_tariff_households",
    """SELECT "Acorn_grouped", count(DISTINCT "LCLid") FILTER ("stdorToU" = 'Std') AS "Std", count(DISTINCT "LCLid") FILTER ("stdorToU" = 'ToU') AS "ToU" FROM merged GROUP BY 1""",
)
def _(fx):
    return an.crosstab(fx.merged(), "Acorn_grouped", "stdorToU", ["Std", "ToU"], distinct_of=ID)


@query(
    "crosstab_row_pct",
    """SELECT "Acorn_grouped", "stdorToU", count(*) AS rows, {{count(*) / sum(count(*)) OVER (PARTITION BY "Acorn_grouped") * 100}} AS pct FROM merged GROUP BY 1, 2""",
)
def _(fx):
    return an.crosstab_row_pct(fx.merged(), "Acorn_grouped", "stdorToU")


@query(
    "high_usage_households",
    """SELECT "LCLid", day, {{total_kwh}} AS total_kwh FROM meter WHERE "LCLid" IN (SELECT "LCLid" FROM (SELECT "LCLid", avg(total_kwh) AS m FROM meter GROUP BY 1)
    WHERE m >= (SELECT quantile_cont(m, 0.75) - 1e-9 FROM (SELECT avg(total_kwh) AS m FROM meter GROUP BY "LCLid")))""",
)
def _(fx):
    return an.high_usage_households(fx.meter())


@query("daily_demand", "SELECT day, {{sum(total_kwh)}} AS demand_kwh FROM meter GROUP BY 1")
def _(fx):
    return an.daily_demand(fx.meter())


@query("households_per_cluster", 'SELECT cluster, count(DISTINCT "LCLid") AS households FROM clusters GROUP BY 1')
def _(fx):
    return an.households_per_cluster(fx.clusters())


@query(
    "seasonal_weather_means",
    'SELECT season, {{avg("temperatureMax")}} AS temperature_max, {{avg(humidity)}} AS humidity, {{avg(total_kwh)}} AS mean_kwh FROM merged GROUP BY 1',
)
def _(fx):
    return an.seasonal_weather_means(fx.merged())


# --- bins, extremes, trends ---------------------------------------------------------------


@query("fixed_bins", f'SELECT "LCLid", day, {_BAND.format(c=chr(34) + "temperatureMax" + chr(34))} AS temp_band FROM merged')
def _(fx):
    return an.fixed_bins(fx.merged()).select(ID, DAY, "temp_band")


@query(
    "equal_width_bins",
    """SELECT "LCLid", day, CASE WHEN heating_degree_days IS NULL THEN NULL ELSE least(greatest(ceil((heating_degree_days - lo) / w), 1), 5)::int END AS hdd_bin FROM feat,
    (SELECT min(heating_degree_days) AS lo, (max(heating_degree_days) - min(heating_degree_days)) / 5 AS w FROM feat)""",
)
def _(fx):
    return an.equal_width_bins(fx.features()).select(ID, DAY, "hdd_bin")


@query(
    "extreme_days",
    """SELECT "LCLid", day, CASE WHEN "temperatureMax" > q[2] THEN 'high' ELSE 'low' END AS extreme FROM merged,
    (SELECT quantile_cont("temperatureMax", [0.05, 0.95]) AS q FROM merged) WHERE "temperatureMax" > q[2] OR "temperatureMax" < q[1]""",
)
def _(fx):
    return an.extreme_days(fx.merged()).select(ID, DAY, "extreme")


@query(
    "hdd_corr_by_cluster",
    """SELECT cluster, {{covar_pop(total_kwh, heating_degree_days) / nullif(stddev_pop(total_kwh) * stddev_pop(heating_degree_days), 0)}} AS corr
    FROM fclusters WHERE heating_degree_days IS NOT NULL GROUP BY 1""",
)
def _(fx):
    return an.hdd_corr_by_cluster(fx.feature_clusters())


def _trend(x: str, keys: str) -> str:
    by = f"GROUP BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}{{{{regr_slope(total_kwh, {x})}}}} AS slope, {{{{regr_intercept(total_kwh, {x})}}}} AS intercept, count(*) AS n FROM fclusters WHERE {x} IS NOT NULL {by}"""


for _name, _x, _keys in (
    ("trend_line_temp", "temp_avg", []),
    ("trend_line_hdd_by_acorn", "heating_degree_days", ["Acorn_grouped"]),
    ("trend_line_cdd_by_tariff", "cooling_degree_days", ["stdorToU"]),
    ("trend_line_temp_by_season", "temp_avg", ["season"]),
    ("trend_line_hdd_by_cluster", "heating_degree_days", ["cluster"]),
):

    @query(_name, _trend(_x, ", ".join(f'"{k}"' for k in _keys)), digits=4)
    def _(fx, x=_x, keys=_keys):
        return an.trend_line(fx.feature_clusters(), x, keys=keys)


@query(
    "top_k_groups",
    """SELECT "LCLid", day, "Acorn" FROM merged WHERE "Acorn" IN (SELECT "Acorn" FROM merged WHERE "Acorn" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, "Acorn" LIMIT 4)""",
)
def _(fx):
    return an.top_k_groups(fx.merged(), "Acorn", 4).select(ID, DAY, "Acorn")


_PIV = ", ".join(f'{{{{avg(total_kwh) FILTER (cluster = {c})}}}} AS "{c}"' for c in range(3))


@query("signature_by_monthday", f"SELECT strftime(day, '%m-%d') AS month_day, {_PIV} FROM clusters GROUP BY 1")
def _(fx):
    return an.signature_by_monthday(fx.clusters(), [0, 1, 2])


@query("monthly_mean_pivot", f"SELECT date_trunc('month', day)::date AS month_period, {_PIV} FROM clusters GROUP BY 1")
def _(fx):
    return an.monthly_mean_pivot(fx.clusters(), [0, 1, 2])


@query(
    "monthly_profile_mean",
    """SELECT month_period, cluster, {{avg(m)}} AS mean_of_slots FROM (SELECT date_trunc('month', p.day)::date AS month_period, cluster, slot, avg(x) AS m
    FROM pclean c JOIN pcal p ON c."LCLid" = p."LCLid" AND c.day = p.day GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def _(fx):
    return an.monthly_profile_mean(fx.profile_features(), "cluster")


@query(
    "household_summary",
    """SELECT "LCLid", {{avg(l)}} AS mean, {{min(l)}} AS min, {{max(l)}} AS max, {{stddev_samp(l)}} AS std FROM
    (SELECT *, lead(total_kwh) OVER (PARTITION BY "LCLid" ORDER BY day) AS l FROM meter) WHERE "LCLid" = 'MAC000003' GROUP BY 1""",
)
def _(fx):
    return an.household_summary(panel.label_day_ahead(fx.meter()), "MAC000003")


@query(
    "quadrants",
    """SELECT c.*, CASE WHEN mk >= qk AND mv >= qv THEN 'Peak Reduction' WHEN mv >= qv THEN 'Load Stabilization' WHEN mk >= qk THEN 'High use, low variability'
    ELSE 'Low use, low variability' END AS quadrant FROM (SELECT cluster, {{mk}} AS mean_kwh, {{mv}} AS mean_variability FROM s) c JOIN s USING (cluster),
    (SELECT quantile_cont(mk, 0.5) AS qk, quantile_cont(mv, 0.5) AS qv FROM s)""".replace(
        "SELECT c.*", "WITH s AS (SELECT cluster, avg(total_kwh) AS mk, avg(std_kwh) AS mv FROM pcal GROUP BY 1) SELECT c.*", 1
    ),
)
def _(fx):
    return an.quadrants(fx.profile_features(), "daily_variability")


# --- anomalies ---------------------------------------------------------------------------


@query(
    "anomaly_global",
    """SELECT "LCLid", day, {{z}} AS zscore_global, (abs(z) > 3)::int AS is_anomaly_global FROM
    (SELECT *, (total_kwh - avg(total_kwh) OVER ()) / stddev_samp(total_kwh) OVER () AS z FROM meter)""",
)
def _(fx):
    return no.anomaly_global(fx.meter()).drop("total_kwh")


@query(
    "anomaly_global_rate",
    """SELECT count(*) AS days, sum((abs(z) > 3)::int)::bigint AS anomalies, {{avg((abs(z) > 3)::int)}} AS rate FROM
    (SELECT *, (total_kwh - avg(total_kwh) OVER ()) / stddev_samp(total_kwh) OVER () AS z FROM meter)""",
)
def _(fx):
    return no.anomaly_rate(no.anomaly_global(fx.meter()), "is_anomaly_global")


def _zp(eps: str, src: str = "meter") -> str:
    return f"""(SELECT *, (total_kwh - avg(total_kwh) OVER w) / nullif(stddev_samp(total_kwh) OVER w + {eps}, 0) AS z FROM {src} WINDOW w AS (PARTITION BY "LCLid"))"""


@query(
    "anomaly_household",
    f'SELECT "LCLid", day, {{{{z}}}} AS zscore_personal, coalesce(abs(z) > 2.5, false)::int AS is_anomaly_personal FROM {_zp("1e-6")}',
)
def _(fx):
    return no.anomaly_household(fx.meter()).drop("total_kwh")


@query(
    "anomaly_household_noeps",
    f'SELECT "LCLid", day, {{{{z}}}} AS zscore_personal, coalesce(abs(z) > 2.5, false)::int AS is_anomaly_personal FROM {_zp("0e0")}',
)
def _(fx):
    return no.anomaly_household(fx.meter(), eps=0.0).drop("total_kwh")


for _name, _key in (("anomaly_rate_by_acorn", "Acorn_grouped"), ("anomaly_rate_by_tariff", "stdorToU"), ("anomaly_rate_by_season", "season")):

    @query(
        _name,
        f"""SELECT "{_key}", count(*) AS days, sum(f)::bigint AS anomalies, {{{{avg(f)}}}} AS rate FROM (SELECT *, coalesce(abs(z) > 2.5, false)::int AS f FROM {_zp("1e-6", "merged")})
        WHERE "{_key}" IS NOT NULL GROUP BY 1""",
    )
    def _(fx, key=_key):
        return no.anomaly_rate_by(no.anomaly_household(fx.merged()), key)


@query(
    "outlier_cap_rule",
    """SELECT "LCLid", day, {{total_kwh}} AS total_kwh, {{z}} AS zscore_global, (abs(z) > 3)::int AS is_anomaly_global, (total_kwh > 100)::int AS is_above_max FROM
    (SELECT *, (total_kwh - avg(total_kwh) OVER ()) / stddev_samp(total_kwh) OVER () AS z FROM meter) WHERE abs(z) > 3 OR total_kwh > 100""",
)
def _(fx):
    return no.outlier_cap_rule(fx.meter())


# --- sorts, limits, sets -------------------------------------------------------------------


@query("sort_panel", 'SELECT "LCLid", day, {{total_kwh}} AS total_kwh FROM meter ORDER BY 1, 2')
def _(fx):
    return panel.sort_panel(fx.meter())


@query("top_n", 'SELECT "LCLid", day, {{total_kwh}} AS total_kwh FROM meter ORDER BY total_kwh DESC, "LCLid", day LIMIT 15')
def _(fx):
    return an.top_n(fx.meter(), "total_kwh", 15, ties=[ID, DAY])


@query("bottom_n", 'SELECT "LCLid", day, {{total_kwh}} AS total_kwh FROM meter ORDER BY total_kwh, "LCLid", day LIMIT 15')
def _(fx):
    return an.top_n(fx.meter(), "total_kwh", 15, largest=False, ties=[ID, DAY])


@query(
    "top_n_per_key",
    """SELECT "LCLid", day, cluster, {{total_kwh}} AS total_kwh, r::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY total_kwh DESC, "LCLid", day) AS r FROM clusters) WHERE r <= 5""",
)
def _(fx):
    return an.top_n_per_key(fx.clusters(), ["cluster"], "total_kwh", 5, ties=[ID, DAY])


@query("most_frequent_household", 'SELECT "LCLid", count(*) AS rows FROM meter GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1')
def _(fx):
    return an.most_frequent_household(fx.meter())


@query(
    "union_all",
    """SELECT split, count(*) AS rows, {{sum(y_true)}} AS kwh FROM pred1 WHERE split IN ('train', 'val') GROUP BY 1""",
)
def _(fx):
    p = fx.prediction1()
    both = readers.union_all(p.where("split = 'train'"), p.where("split = 'val'"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("y_true").alias("kwh"))


@query("distinct", 'SELECT DISTINCT "LCLid", cluster FROM clusters')
def _(fx):
    return fx.clusters().select(ID, "cluster").distinct()
