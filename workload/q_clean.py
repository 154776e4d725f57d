"""Joins, cleaning and gap filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions import profile as prof
from wattloom.operators import clean, panel
from wattloom.plans import feature_table as ft
from wattloom.schema import DAY, ID, PROFILE, WEATHER_VALUES

from .base import query

WX = ", ".join(f'{{{{"{c}"}}}} AS "{c}"' for c in WEATHER_VALUES)


@query(
    "join_household",
    'SELECT m."LCLid", m.day, {{total_kwh}} AS total_kwh, "Acorn", "Acorn_grouped", "stdorToU" FROM meter m LEFT JOIN household h ON m."LCLid" = h."LCLid"',
)
def _(fx):
    return clean.join_household(fx.meter(), fx.household())


@query("join_weather", f'SELECT "LCLid", m.day, {{{{total_kwh}}}} AS total_kwh, {WX} FROM meter m LEFT JOIN wx w ON m.day = w.day')
def _(fx):
    return clean.join_weather(fx.meter(), fx.weather())


@query(
    "join_holiday",
    'SELECT "LCLid", m.day, {{total_kwh}} AS total_kwh, holiday_type, holiday_category FROM meter m LEFT JOIN hol h ON m.day = h.day',
)
def _(fx):
    return clean.join_holiday(fx.meter(), fx.holiday())


@query(
    "merge_all",
    f'SELECT "LCLid", day, {{{{total_kwh}}}} AS total_kwh, "Acorn", "Acorn_grouped", "stdorToU", {WX}, holiday_type, holiday_category FROM merged',
)
def _(fx):
    return clean.merge_all(fx.meter(), fx.household(), fx.weather(), fx.holiday())


@query(
    "semi_join_ids",
    'SELECT "LCLid", day, {{total_kwh}} AS total_kwh FROM meter WHERE "LCLid" IN (SELECT "LCLid" FROM meter GROUP BY 1 HAVING avg(total_kwh) > 29)',
)
def _(fx):
    m = fx.meter()
    ids = m.groupBy(ID).agg(F.avg("total_kwh").alias("a")).where("a > 29")
    return clean.semi_join_ids(m, ids)


@query(
    "join_back_stats",
    """SELECT "LCLid", day, {{avg(total_kwh) OVER w}} AS hh_avg_consumption, {{stddev_samp(total_kwh) OVER w}} AS hh_std_consumption,
    {{max(total_kwh) OVER w}} AS hh_max_consumption, {{min(total_kwh) OVER w}} AS hh_min_consumption FROM meter WINDOW w AS (PARTITION BY "LCLid")""",
)
def _(fx):
    return clean.join_back_stats(fx.meter()).drop("total_kwh")


_R = """(covar_pop(total_kwh, t) / nullif(stddev_pop(total_kwh) * stddev_pop(t), 0))"""


@query(
    "map_group_value",
    f"""SELECT m."LCLid", m.day, {{{{r}}}} AS temp_sensitivity FROM meter m LEFT JOIN (SELECT "LCLid", {_R} AS r FROM
    (SELECT "LCLid", total_kwh, temp_avg AS t FROM feat WHERE temp_avg IS NOT NULL) GROUP BY 1) c ON m."LCLid" = c."LCLid" """,
)
def _(fx):
    from wattloom.functions.weather import temp_sensitivity

    return temp_sensitivity(fx.features()).select(ID, DAY, "temp_sensitivity")


@query(
    "join_week_label",
    """SELECT f."LCLid", f.day, dayofweek, {{label_7}} AS label_7 FROM cal f JOIN (SELECT "LCLid", day, lead(total_kwh, 7) OVER (PARTITION BY "LCLid" ORDER BY day) AS label_7
    FROM meter) l ON f."LCLid" = l."LCLid" AND f.day = l.day WHERE label_7 IS NOT NULL""",
)
def _(fx):
    return panel.join_week_label(fx.calendar().select(ID, DAY, "dayofweek"), fx.meter())


@query(
    "join_forecast_actuals",
    'SELECT p."LCLid" AS unique_id, p.day AS ds, {{y_pred}} AS y_pred, {{total_kwh}} AS y FROM pred1 p JOIN meter m ON p."LCLid" = m."LCLid" AND p.day = m.day',
)
def _(fx):
    fc = fx.prediction1().select(F.col(ID).alias("unique_id"), F.col(DAY).alias("ds"), "y_pred")
    actual = fx.meter().select(F.col(ID).alias("unique_id"), F.col(DAY).alias("ds"), F.col("total_kwh").alias("y"))
    return clean.join_forecast_actuals(fc, actual)


@query(
    "join_forecast_actuals_left",
    'SELECT m."LCLid" AS unique_id, m.day AS ds, {{total_kwh}} AS y, {{y_pred}} AS y_pred FROM meter m LEFT JOIN pred1 p ON p."LCLid" = m."LCLid" AND p.day = m.day',
)
def _(fx):
    fc = fx.prediction1().select(F.col(ID).alias("unique_id"), F.col(DAY).alias("ds"), "y_pred")
    actual = fx.meter().select(F.col(ID).alias("unique_id"), F.col(DAY).alias("ds"), F.col("total_kwh").alias("y"))
    return clean.join_forecast_actuals(actual, fc, "left")


@query(
    "join_stats_to_dim",
    """SELECT m."LCLid", {{avg(total_kwh)}} AS mean_kwh, h."Acorn_grouped" FROM meter m JOIN household h ON m."LCLid" = h."LCLid" GROUP BY m."LCLid", h."Acorn_grouped" """,
)
def _(fx):
    stats = fx.meter().groupBy(ID).agg(F.avg("total_kwh").alias("mean_kwh"))
    return clean.join_stats_to_dim(stats, fx.household(), ["Acorn_grouped"])


# --- gap filling --------------------------------------------------------------------------


@query(
    "interpolate_profile",
    'SELECT "LCLid", day, ' + ", ".join(f"{{{{max(x) FILTER (slot = {i})}}}} AS hh_{i}" for i in range(48)) + " FROM pfill GROUP BY 1, 2",
)
def _(fx):
    return prof.to_columns(clean.interpolate_profile(fx.profiles_raw()))


@query("dedup_weather_days", f"SELECT day, {WX} FROM wday")
def _(fx):
    return fx.weather_days()


@query("report_duplicate_days", "SELECT cast(time AS date) AS day, count(*) AS n FROM wraw GROUP BY 1 HAVING count(*) > 1")
def _(fx):
    return clean.report_duplicate_days(clean.select_weather_cols(fx.weather_raw()))


@query("interpolate_weather_time", f"SELECT day, {WX} FROM wx")
def _(fx):
    return fx.weather()


@query("normalize_day", "SELECT o_orderkey, cast(o_orderdate AS date) AS day FROM orders")
def _(fx):
    return clean.normalize_day(fx.table("orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query(
    "clean_and_merge",
    f"""SELECT s."LCLid", s.day, {{{{s.total_kwh}}}} AS total_kwh, s.peak_hour, h."Acorn", h."Acorn_grouped", h."stdorToU",
    {", ".join(f'{{{{w."{c}"}}}} AS "{c}"' for c in WEATHER_VALUES)}, coalesce(x.holiday_category, 'Regular Day') AS holiday_category,
    s.month, s.season FROM pcal s LEFT JOIN household h ON s."LCLid" = h."LCLid" LEFT JOIN wx w ON s.day = w.day LEFT JOIN hol x ON s.day = x.day
    WHERE s."LCLid" IN (SELECT "LCLid" FROM pkeep GROUP BY 1 HAVING count(*) >= 30)""",
)
def _(fx):
    df = ft.clean_and_merge(fx.profiles_raw(), fx.household(), fx.weather_raw(), fx.holiday_raw())
    total, peak = prof.array_total(F.col(PROFILE)), prof.first_peak(F.col(PROFILE))
    return df.select(
        ID, DAY, total.alias("total_kwh"), peak.alias("peak_hour"), "Acorn", "Acorn_grouped", "stdorToU",
        *WEATHER_VALUES, "holiday_category", "month", "season",
    )


@query(
    "cap_at_quantile",
    """SELECT "LCLid", day, {{least(r, (SELECT quantile_cont(r, 0.95) FROM (SELECT day_sum / CASE WHEN night_sum = 0 THEN 0.001e0 ELSE night_sum END AS r FROM pstat)))}} AS day_night_hours
    FROM (SELECT "LCLid", day, day_sum / CASE WHEN night_sum = 0 THEN 0.001e0 ELSE night_sum END AS r FROM pstat)""",
)
def _(fx):
    df = prof.day_night_ratio_hours(fx.profiles(), zero_as=0.001)
    return clean.cap_at_quantile(df.select(ID, DAY, "day_night_hours"), "day_night_hours")


@query(
    "inf_to_null",
    """SELECT "LCLid", day, {{CASE WHEN y_true = y_pred THEN NULL ELSE y_true / (y_true - y_pred) END}} AS r FROM pred1""",
)
def _(fx):
    gap = F.col("y_true") - F.col("y_pred")
    raw = F.when(gap == 0, F.lit(float("inf"))).otherwise(F.try_divide("y_true", gap))
    return clean.inf_to_null(fx.prediction1().select(ID, DAY, raw.alias("r")), ["r"])


@query(
    "cleaning_report",
    """WITH base AS (SELECT g."LCLid", g.day, (count(*) FILTER (v IS NULL) / 48e0 < 0.2e0) AS dense FROM pgrid g GROUP BY 1, 2),
    active AS (SELECT "LCLid" FROM base WHERE dense GROUP BY 1 HAVING count(*) >= 30),
    kept AS (SELECT b.* FROM base b JOIN active a ON a."LCLid" = b."LCLid" WHERE dense)
    SELECT '1 input' AS stage, count(*) AS rows, count(DISTINCT "LCLid") AS households FROM base
    UNION ALL SELECT '2 dense days', count(*), count(DISTINCT "LCLid") FROM base WHERE dense
    UNION ALL SELECT '3 active households', count(*), count(DISTINCT "LCLid") FROM kept
    UNION ALL SELECT '4 household matched', count(*), count(DISTINCT "LCLid") FROM kept WHERE "LCLid" IN (SELECT "LCLid" FROM household)
    UNION ALL SELECT '5 weather matched', count(*), count(DISTINCT "LCLid") FROM kept WHERE day IN (SELECT day FROM wx)
    UNION ALL SELECT '6 holiday matched', count(*), count(DISTINCT "LCLid") FROM kept WHERE day IN (SELECT day FROM hol)""",
)
def _(fx):
    return clean.cleaning_report(fx.profiles_raw(), fx.household(), fx.weather(), fx.holiday())
