"""Scans, sinks, projections, filters and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions import calendar as cal
from wattloom.functions import profile as prof
from wattloom.operators import clean, columns, encode, splits
from wattloom.plans import training
from wattloom.schema import DAY, ID, PROFILE
from wattloom.session import scratch_path
from wattloom.sources import readers, writers

from .base import query

PIVOT = ", ".join(f"{{{{max(v) FILTER (slot = {i})}}}} AS hh_{i}" for i in range(48))
PIVOT_CLEAN = ", ".join(f"{{{{max(x) FILTER (slot = {i})}}}} AS hh_{i}" for i in range(48))


def _csv(fx, df, name):
    path = scratch_path(fx.spark, name)
    df.write.option("header", True).csv(path)
    return path


# --- scans and sinks -----------------------------------------------------------------


@query("scan_halfhourly", f'SELECT "LCLid", day, {PIVOT} FROM pgrid GROUP BY 1, 2')
def _(fx):
    path = _csv(fx, prof.to_columns(fx.profiles_raw()), "blocks")
    return readers.scan_halfhourly(fx.spark, f"{path}/part-*.csv")


@query("scan_household", 'SELECT "LCLid", "stdorToU", "Acorn", "Acorn_grouped" FROM household')
def _(fx):
    return readers.scan_household(fx.spark, _csv(fx, fx.household(), "household"))


@query(
    "scan_weather",
    'SELECT time, {{"temperatureMax"}} AS "temperatureMax", {{"temperatureMin"}} AS "temperatureMin", '
    '{{humidity}} AS humidity, {{"windSpeed"}} AS "windSpeed", {{"cloudCover"}} AS "cloudCover" FROM wraw',
)
def _(fx):
    return readers.scan_weather(fx.spark, _csv(fx, fx.weather_raw(), "weather"))


@query("scan_holiday", 'SELECT "Bank holidays", "Type" FROM hraw')
def _(fx):
    return readers.scan_holiday(fx.spark, _csv(fx, fx.holiday_raw(), "holiday"))


@query(
    "load_bundle",
    """SELECT 'consumption' AS name, count(*) AS rows FROM (SELECT DISTINCT "LCLid", day FROM praw)
    UNION ALL SELECT 'weather', count(*) FROM wraw UNION ALL SELECT 'household', count(*) FROM household
    UNION ALL SELECT 'holiday', count(*) FROM hraw""",
)
def _(fx):
    root = scratch_path(fx.spark, "bundle")
    parts = {
        "hhblock_dataset/hhblock_dataset/block_0.csv": prof.to_columns(fx.profiles_raw()),
        "weather_daily_darksky.csv": fx.weather_raw(),
        "informations_households.csv": fx.household(),
        "uk_bank_holidays.csv": fx.holiday_raw(),
    }
    for p, df in parts.items():
        df.write.option("header", True).csv(f"{root}/{p}")
    bundle = readers.load_bundle(fx.spark, root)
    return readers.union_all(
        *[df.agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("rows")) for k, df in bundle.items()]
    )


@query(
    "scan_features",
    'SELECT "LCLid", day, {{lag1_total}} AS lag1_total, {{roll7_total_mean}} AS roll7_total_mean FROM lagged',
)
def _(fx):
    path = scratch_path(fx.spark, "features")
    writers.write_features(fx.lagged(), path)
    return readers.scan_features(fx.spark, path, [ID, DAY, "lag1_total", "roll7_total_mean"])


@query(
    "write_features",
    """SELECT date_trunc('month', day)::date AS month_start, count(*) AS rows, {{sum(total_kwh)}} AS kwh FROM meter GROUP BY 1""",
)
def _(fx):
    path = scratch_path(fx.spark, "features")
    writers.write_features(fx.meter(), path)
    return fx.spark.read.parquet(path).groupBy("month_start").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("total_kwh").alias("kwh")
    )


@query(
    "model_round_trip",
    """SELECT "LCLid", day, {{total_kwh}} AS y_true, {{a + b * lag1_total}} AS y_pred FROM lagged,
    (SELECT regr_intercept(total_kwh, lag1_total) AS a, regr_slope(total_kwh, lag1_total) AS b FROM lagged WHERE lag7_total IS NOT NULL) WHERE lag7_total IS NOT NULL""",
)
def _(fx):
    """Fitted on one input, saved, loaded and scored."""
    df = fx.contribution_input()
    model, _, _ = training.fit_linear(df, ["lag1_total"], "total_kwh")
    path = scratch_path(fx.spark, "model")
    writers.save_model(model, path)
    return training.score_splits(writers.load_model(path), df, "total_kwh", (ID, DAY))


@query("model_io")
def _(fx):
    df = fx.contribution_input().withColumn("label", F.col("total_kwh"))
    feats = ["lag1_total", "lag7_total", "roll7_total_mean"]
    model, _, _ = training.fit_linear(df, feats, "label")
    path = scratch_path(fx.spark, "model")
    writers.save_model(model, path)
    return training.score_splits(writers.load_model(path), df, "label", (ID, DAY))


@query(
    "pack_readings",
    f"""SELECT "LCLid", day, {", ".join(f"{{{{coalesce(sum(kwh) FILTER (slot = {i}), 0)}}}} AS hh_{i}" for i in range(48))}
    FROM (SELECT "LCLid", cast(ts AS date) AS day, kwh, hour(ts) * 2 + (minute(ts) >= 30)::int AS slot FROM readings) GROUP BY 1, 2""",
)
def _(fx):
    return prof.to_columns(clean.pack_readings(fx.readings(), fill=0.0))


@query(
    "unpack_profile",
    """SELECT "LCLid", day, slot, {{x}} AS kwh, concat(lpad(cast(slot // 2 AS varchar), 2, '0'), ':', CASE WHEN slot % 2 = 0 THEN '00' ELSE '30' END) AS label FROM pclean""",
)
def _(fx):
    return clean.unpack_profile(fx.profiles()).withColumn("slot", F.col("slot").cast("int"))


# --- projections and filters -----------------------------------------------------------


@query(
    "drop_sparse_days",
    'SELECT g."LCLid", g.day, count(v) AS known FROM pgrid g JOIN pkeep k ON g."LCLid" = k."LCLid" AND g.day = k.day GROUP BY 1, 2',
)
def _(fx):
    known = F.size(F.filter(PROFILE, lambda x: x.isNotNull())).cast("bigint")
    return clean.drop_sparse_days(fx.profiles_raw()).select(ID, DAY, known.alias("known"))


@query(
    "keep_active_households",
    """SELECT "LCLid", day FROM (SELECT "LCLid", day, count(*) OVER (PARTITION BY "LCLid") AS n FROM meter) WHERE n >= 530""",
)
def _(fx):
    return clean.keep_active_households(fx.meter(), min_days=530).select(ID, DAY)


@query("select_household_cols", 'SELECT "LCLid", "Acorn", "Acorn_grouped", "stdorToU" FROM household')
def _(fx):
    return clean.select_household_cols(fx.household().withColumn("other", F.lit(1)))


@query(
    "select_weather_cols",
    'SELECT cast(time AS date) AS day, {{"temperatureMax"}} AS "temperatureMax", {{humidity}} AS humidity FROM wraw',
)
def _(fx):
    return clean.select_weather_cols(fx.weather_raw()).select(DAY, "temperatureMax", "humidity")


@query("map_holiday_category", "SELECT day, holiday_type, holiday_category FROM hol")
def _(fx):
    return fx.holiday()


@query("fill_holiday_default", 'SELECT "LCLid", day, holiday_category FROM merged')
def _(fx):
    df = clean.join_holiday(fx.meter(), fx.holiday())
    return clean.fill_holiday_default(df).select(ID, DAY, "holiday_category")


@query(
    "filter_complete_profiles",
    """SELECT "LCLid", day FROM pgrid WHERE month(day) IN (12, 1, 2, 6, 7, 8) GROUP BY 1, 2 HAVING count(v) = 48""",
)
def _(fx):
    df = cal.season_of_month(cal.month_of_day(fx.profiles_raw()))
    return clean.filter_complete_profiles(df, ["Winter", "Summer"]).select(ID, DAY)


@query("filter_not_null", 'SELECT "LCLid", day, {{"temperatureMax"}} AS "temperatureMax" FROM merged WHERE "temperatureMax" IS NOT NULL')
def _(fx):
    return fx.merged().na.drop(subset=["temperatureMax"]).select(ID, DAY, "temperatureMax")


@query("select_scope", """SELECT "LCLid", day, {{total_kwh}} AS total_kwh FROM meter WHERE "LCLid" IN (SELECT "LCLid" FROM household WHERE "stdorToU" = 'ToU')""")
def _(fx):
    return splits.select_scope(fx.meter(), fx.household().where("stdorToU = 'ToU'"))


@query("drop_columns_if_present", 'SELECT "LCLid", day, "Acorn" FROM merged')
def _(fx):
    df = fx.merged().select(ID, DAY, "Acorn", "season")
    return columns.drop_columns_if_present(df, ["season", "kmeans_cluster"])


@query(
    "drop_leakage_columns",
    'SELECT "LCLid", day, "Acorn_grouped", "stdorToU", {{"temperatureMax"}} AS "temperatureMax", {{humidity}} AS humidity, '
    "dayofweek, is_weekend, is_weekday, month, season, peak_hour, cluster FROM pcal",
)
def _(fx):
    df = fx.profile_features().select(
        ID, DAY, "Acorn_grouped", "stdorToU", "temperatureMax", "humidity", "dayofweek", "is_weekend", "is_weekday",
        "month", "season", "total_kwh", "mean_kwh", "std_kwh", "peak_kwh", "min_kwh", "peak_hour", "morning_kwh",
        "night_kwh", "base_load", "base_load_ratio", "load_factor", "day_night_ratio", "daily_variability", "cluster",
    )
    return columns.drop_leakage_columns(df)


@query(
    "select_stage0_features",
    'SELECT "Acorn_grouped", "stdorToU", {{"temperatureMax"}} AS "temperatureMax", {{humidity}} AS humidity, is_weekend, month, season, '
    "peak_hour, cluster, {{peak_kwh / mean_kwh}} AS peak_to_mean_ratio, {{total_kwh}} AS total_kwh FROM pcal",
)
def _(fx):
    df = fx.profile_features().select(
        ID, DAY, "Acorn_grouped", "stdorToU", "temperatureMax", "humidity", "dayofweek", "is_weekend", "is_weekday",
        "month", "season", "holiday_type", "total_kwh", "mean_kwh", "peak_kwh", "peak_hour", "base_load",
        "usage_concentration", "peak_sharpness", "peak_to_mean_ratio", "cluster",
    )
    return columns.select_study_features(df)


_GROUP_COLS = ["dayofweek", "is_weekend", "month", "temp_avg", "heating_degree_days", "lag1_total", "roll7_total_mean", "Acorn_grouped", "stdorToU", "humidity"]
_G = {
    "forecast": [("temporal", "dayofweek is_weekend month"), ("weather", "temp_avg heating_degree_days"), ("lags", "lag1_total"),
                 ("rolling", "roll7_total_mean"), ("static_household", "Acorn_grouped stdorToU"), ("other", "humidity")],
    "random_study": [("weather", "temp_avg heating_degree_days humidity"), ("calendar", "dayofweek is_weekend month"),
                     ("socio_economic", "Acorn_grouped"), ("past_use", "lag1_total roll7_total_mean")],
    "dated_study": [("temporal", "dayofweek is_weekend month"), ("weather", "temp_avg heating_degree_days humidity"),
                    ("socio_economic", "Acorn_grouped"), ("external", "stdorToU"), ("other", "lag1_total roll7_total_mean")],
}
_GROUP_SQL = " UNION ALL ".join(
    f"SELECT '{r}' AS rules, '{c}' AS feature, '{g}' AS \"group\", count(\"{c}\") AS known_rows FROM lagged"
    for r, gs in _G.items() for g, cs in gs for c in cs.split()
)


@query("feature_groups", _GROUP_SQL)
def _(fx):
    df = fx.lagged().select(*_GROUP_COLS)
    return readers.union_all(
        *[columns.feature_group_table(df, _GROUP_COLS, r).select(F.lit(r).alias("rules"), "*") for r in _G]
    )


# --- encoders and scalers ----------------------------------------------------------------


@query(
    "encode_labels",
    """SELECT m."LCLid", m.day, (c.k - 1)::int AS household_code FROM meter m
    JOIN (SELECT "LCLid", dense_rank() OVER (ORDER BY "LCLid") AS k FROM (SELECT DISTINCT "LCLid" FROM meter)) c ON m."LCLid" = c."LCLid" """,
)
def _(fx):
    return encode.encode_labels(fx.meter(), ID, "household_code").select(ID, DAY, "household_code")


@query(
    "encode_category_codes",
    """SELECT g."LCLid", g.day, coalesce(a.k - 1, -1)::int AS "Acorn_code", coalesce(t.k - 1, -1)::int AS "holiday_type_code" FROM merged g
    LEFT JOIN (SELECT "Acorn", dense_rank() OVER (ORDER BY "Acorn") AS k FROM (SELECT DISTINCT "Acorn" FROM merged WHERE "Acorn" IS NOT NULL)) a ON g."Acorn" = a."Acorn"
    LEFT JOIN (SELECT holiday_type, dense_rank() OVER (ORDER BY holiday_type) AS k FROM (SELECT DISTINCT holiday_type FROM merged WHERE holiday_type IS NOT NULL)) t ON g.holiday_type = t.holiday_type""",
)
def _(fx):
    df = fx.merged().select(ID, DAY, "Acorn", "holiday_type")
    return encode.encode_category_codes(df, ["Acorn", "holiday_type"]).select(ID, DAY, "Acorn_code", "holiday_type_code")


@query(
    "fit_apply_encoder",
    """SELECT o."LCLid", o.day, coalesce(c.k - 1, (SELECT count(DISTINCT "LCLid") FROM meter WHERE day < DATE '1995-01-20'))::int AS code
    FROM (SELECT * FROM meter WHERE day >= DATE '1995-01-20') o LEFT JOIN (SELECT "LCLid", dense_rank() OVER (ORDER BY "LCLid") AS k
      FROM (SELECT DISTINCT "LCLid" FROM meter WHERE day < DATE '1995-01-20')) c ON o."LCLid" = c."LCLid" """,
)
def _(fx):
    m = fx.meter()
    train, other = m.where("day < DATE'1995-01-20'"), m.where("day >= DATE'1995-01-20'")
    return encode.fit_apply_encoder(train, other, ID, "code", unseen="keep").select(ID, DAY, "code")


@query(
    "scale_standard",
    """SELECT "LCLid", day, {{(total_kwh - m1) / s1}} AS total_kwh_z, {{("temperatureMax" - m2) / s2}} AS "temperatureMax_z" FROM merged,
    (SELECT avg(total_kwh) m1, stddev_pop(total_kwh) s1, avg("temperatureMax") m2, stddev_pop("temperatureMax") s2 FROM merged WHERE day < DATE '2000-01-01')""",
)
def _(fx):
    cols = ["total_kwh", "temperatureMax"]
    return encode.scale_standard(fx.merged(), cols, F.col(DAY) < F.lit("2000-01-01").cast("date")).select(
        ID, DAY, "total_kwh_z", "temperatureMax_z"
    )


@query(
    "scale_robust",
    """SELECT m."LCLid", day, {{(total_kwh - q2) / nullif(q3 - q1, 0)}} AS total_kwh_robust FROM meter m JOIN (SELECT "LCLid", quantile_cont(total_kwh, 0.25) q1,
    quantile_cont(total_kwh, 0.5) q2, quantile_cont(total_kwh, 0.75) q3 FROM meter GROUP BY 1) q ON m."LCLid" = q."LCLid" """,
)
def _(fx):
    return encode.scale_robust(fx.meter(), "total_kwh").select(ID, DAY, "total_kwh_robust")


@query(
    "log_target",
    'SELECT "LCLid", day, {{ln(1 + y_true)}} AS y_log, {{y_pred}} AS y_back FROM pred1',
)
def _(fx):
    df = fx.prediction1().withColumns({"y_log": F.col("y_true"), "y_back": F.col("y_pred")})
    out = encode.invert_log(encode.log_target(df, ["y_log", "y_back"]), ["y_back"])
    return out.select(ID, DAY, "y_log", "y_back")


@query(
    "dropna_any",
    'SELECT "LCLid", day, {{lag14_total}} AS lag14_total, {{humidity}} AS humidity FROM lagged WHERE lag14_total IS NOT NULL AND humidity IS NOT NULL',
)
def _(fx):
    return encode.dropna_any(fx.lagged(), ["lag14_total", "humidity"]).select(ID, DAY, "lag14_total", "humidity")


@query(
    "dropna_report",
    "SELECT count(*) AS rows_before, count(*) FILTER (lag14_total IS NOT NULL AND humidity IS NOT NULL) AS rows_after FROM lagged",
)
def _(fx):
    return encode.dropna_report(fx.lagged(), ["lag14_total", "humidity"])


@query(
    "cast_numeric_coerce",
    "SELECT event_id, {{try_cast(props[7:length(props) - 1] AS double)}} AS k, {{try_cast(event_type AS double)}} AS t FROM events",
)
def _(fx):
    df = fx.table("events").select("event_id", F.expr("substring(props, 7, length(props) - 7)").alias("k"), F.col("event_type").alias("t"))
    return encode.cast_numeric_coerce(df, ["k", "t"])


@query(
    "forecast_long_form",
    'SELECT "LCLid" AS unique_id, day AS ds, {{total_kwh}} AS y, {{"temperatureMax"}} AS "temperatureMax", month FROM merged WHERE "temperatureMax" IS NOT NULL',
)
def _(fx):
    return columns.forecast_long_form(fx.merged(), ["temperatureMax", "month"])


