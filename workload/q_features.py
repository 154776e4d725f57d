"""Calendar, load-profile and weather features."""

from __future__ import annotations

from wattloom.functions import calendar as cal
from wattloom.functions import profile as prof
from wattloom.functions import weather as wx
from wattloom.operators import columns
from wattloom.schema import DAY, EXPECTED_COLUMNS, HH_COLS, ID, PROFILE

from .base import query
from .oracle import ftab_columns

# --- calendar --------------------------------------------------------------------------


@query(
    "calendar_basic",
    'SELECT "LCLid", day, dayofweek, month, day_of_year, is_weekend, is_weekday, is_monday, is_friday FROM cal',
)
def _(fx):
    return cal.calendar_basic(fx.meter()).drop("total_kwh")


@query("month_of_day", 'SELECT "LCLid", day, month(day)::int AS month FROM meter')
def _(fx):
    return cal.month_of_day(fx.meter()).drop("total_kwh")


@query("season_of_month", 'SELECT "LCLid", day, month, season FROM merged')
def _(fx):
    return cal.season_of_month(cal.month_of_day(fx.meter())).drop("total_kwh")


@query(
    "cyclical_encoding",
    """SELECT "LCLid", day, {{sin(2 * pi() * month / 12)}} AS month_sin, {{cos(2 * pi() * month / 12)}} AS month_cos,
    {{sin(2 * pi() * dayofweek / 7)}} AS dayofweek_sin, {{cos(2 * pi() * dayofweek / 7)}} AS dayofweek_cos FROM cal""",
)
def _(fx):
    return cal.cyclical_encoding(cal.calendar_basic(fx.meter())).select(
        ID, DAY, "month_sin", "month_cos", "dayofweek_sin", "dayofweek_cos"
    )


@query("season_flags", 'SELECT "LCLid", day, is_winter, is_summer, is_shoulder_season FROM cal')
def _(fx):
    df = cal.season_of_month(cal.month_of_day(fx.meter()))
    return cal.season_flags(df).select(ID, DAY, "is_winter", "is_summer", "is_shoulder_season")


@query(
    "holiday_flags",
    """SELECT "LCLid", day, is_holiday, (holiday_category = 'Christmas')::int AS is_christmas, (holiday_category = 'New Year')::int AS is_new_year,
    (holiday_category = 'Bank Holiday')::int AS is_bank_holiday, is_holiday * is_weekday AS holiday_weekday, is_holiday * is_weekend AS holiday_weekend FROM cal""",
)
def _(fx):
    return fx.calendar().select(
        ID, DAY, "is_holiday", "is_christmas", "is_new_year", "is_bank_holiday", "holiday_weekday", "holiday_weekend"
    )


def _peak_sql(p: str) -> str:
    return f"""SELECT "LCLid", day, ({p} IN (7, 8, 9))::int AS is_morning_peak, ({p} IN (17, 18, 19, 20))::int AS is_evening_peak,
    ({p} BETWEEN 0 AND 5)::int AS is_off_peak, is_weekday * ({p} IN (17, 18, 19, 20))::int AS weekday_evening_peak,
    is_weekend * ({p} IN (7, 8, 9))::int AS weekend_peak_shift FROM pcal"""


_PEAK = ["is_morning_peak", "is_evening_peak", "is_off_peak", "weekday_evening_peak", "weekend_peak_shift"]


@query("peak_period_flags", _peak_sql("peak_hour"))
def _(fx):
    return cal.peak_period_flags(prof.peak_slot(cal.calendar_basic(fx.profiles()))).select(ID, DAY, *_PEAK)


@query("peak_period_flags_hours", _peak_sql("(peak_hour // 2)"))
def _(fx):
    df = prof.peak_slot(cal.calendar_basic(fx.profiles()))
    return cal.peak_period_flags(df, unit="hour").select(ID, DAY, *_PEAK)


@query(
    "time_trend",
    """SELECT "LCLid", day, (day - min(day) OVER ())::int AS days_since_start, quarter(day)::int AS quarter, (quarter(day) = 1)::int AS is_q1, (quarter(day) = 4)::int AS is_q4 FROM meter""",
)
def _(fx):
    return cal.time_trend(fx.meter()).drop("total_kwh")


@query(
    "day_type",
    """SELECT "LCLid", day, CASE WHEN is_holiday = 1 THEN 'Holiday' WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END AS day_type FROM cal""",
)
def _(fx):
    return cal.day_type(fx.calendar()).select(ID, DAY, "day_type")


@query(
    "weekday_name",
    """SELECT "LCLid", day, dayname(day) AS weekday_name, (dayname(day) IN ('Saturday', 'Sunday'))::int AS weekend_by_name FROM meter""",
)
def _(fx):
    return cal.weekday_name(cal.calendar_basic(fx.meter())).select(ID, DAY, "weekday_name", "weekend_by_name")


@query(
    "period_keys",
    """SELECT "LCLid", day, date_trunc('month', day)::date AS month_period, strftime(day, '%m-%d') AS month_day, year(day)::int AS year FROM meter""",
)
def _(fx):
    return cal.period_keys(fx.meter()).drop("total_kwh")


# --- load profile ------------------------------------------------------------------------


@query(
    "profile_totals",
    'SELECT "LCLid", day, {{total_kwh}} AS total_kwh, {{mean_kwh}} AS mean_kwh, {{std_kwh}} AS std_kwh, {{peak_kwh}} AS peak_kwh, {{min_kwh}} AS min_kwh FROM pstat',
)
def _(fx):
    return prof.profile_totals(fx.profiles()).drop(PROFILE)


@query("peak_slot", 'SELECT "LCLid", day, peak_hour FROM pstat')
def _(fx):
    return prof.peak_slot(fx.profiles()).drop(PROFILE)


_BLOCKS = ["morning_kwh", "afternoon_kwh", "evening_kwh", "night_kwh"]


@query("tod_blocks", 'SELECT "LCLid", day, ' + ", ".join(f"{{{{{b}}}}} AS {b}" for b in _BLOCKS) + " FROM pstat")
def _(fx):
    return prof.tod_blocks(fx.profiles()).drop(PROFILE)


@query("peak_windows", 'SELECT "LCLid", day, {{peak_period_kwh}} AS peak_period_kwh, {{off_peak_kwh}} AS off_peak_kwh FROM pstat')
def _(fx):
    return prof.peak_windows(fx.profiles()).drop(PROFILE)


@query(
    "tod_blocks_by_hours",
    """SELECT "LCLid", day, {{sum(x) FILTER (slot BETWEEN 12 AND 23)}} AS morning_kwh, {{sum(x) FILTER (slot BETWEEN 24 AND 35)}} AS afternoon_kwh,
    {{sum(x) FILTER (slot >= 36)}} AS evening_kwh, {{sum(x) FILTER (slot < 12)}} AS night_kwh, {{sum(x) FILTER (slot BETWEEN 34 AND 41)}} AS peak_period_kwh,
    {{sum(x) FILTER (slot < 12 OR slot BETWEEN 14 AND 31 OR slot >= 46)}} AS off_peak_kwh FROM pclean GROUP BY 1, 2""",
)
def _(fx):
    return prof.peak_windows(prof.tod_blocks(fx.profiles(), "hours"), "hours").drop(PROFILE)


@query("is_weekday_peak", 'SELECT "LCLid", day, (dayofweek < 5 AND peak_hour IN (17, 18, 19, 20))::int AS is_weekday_peak FROM pcal')
def _(fx):
    return prof.is_weekday_peak(prof.peak_slot(cal.calendar_basic(fx.profiles()))).select(ID, DAY, "is_weekday_peak")


_RATIOS = """{{peak_kwh / nullif(mean_kwh, 0)}} AS peak_to_mean_ratio, {{peak_kwh / nullif(total_kwh, 0)}} AS peak_to_total_ratio,
    {{(morning_kwh + afternoon_kwh) / nullif(evening_kwh + night_kwh, 0)}} AS day_night_ratio, {{mean_kwh / nullif(peak_kwh, 0)}} AS load_factor,
    {{std_kwh / nullif(mean_kwh, 0)}} AS coefficient_of_variation"""
_RATIO_COLS = ["peak_to_mean_ratio", "peak_to_total_ratio", "day_night_ratio", "load_factor", "coefficient_of_variation"]


@query("load_ratios", f'SELECT "LCLid", day, {_RATIOS} FROM pstat')
def _(fx):
    df = prof.tod_blocks(prof.profile_totals(fx.profiles()))
    return prof.load_ratios(df).select(ID, DAY, *_RATIO_COLS)


@query("daily_variability", 'SELECT "LCLid", day, {{std_kwh}} AS daily_variability FROM pstat')
def _(fx):
    return prof.daily_variability(fx.profiles()).drop(PROFILE)


@query("daily_variability_sample", 'SELECT "LCLid", day, {{std1_kwh}} AS daily_variability FROM pstat')
def _(fx):
    return prof.daily_variability(fx.profiles(), ddof=1).drop(PROFILE)


@query("usage_concentration", 'SELECT "LCLid", day, {{sum_sq / (total_kwh * total_kwh)}} AS usage_concentration FROM pstat')
def _(fx):
    return prof.usage_concentration(fx.profiles()).drop(PROFILE)


@query("peak_sharpness", 'SELECT "LCLid", day, {{peak_kwh / (mean_kwh + 1e-6)}} AS peak_sharpness FROM pstat')
def _(fx):
    return prof.peak_sharpness(prof.profile_totals(fx.profiles())).select(ID, DAY, "peak_sharpness")


@query("base_load", 'SELECT "LCLid", day, {{base_load}} AS base_load, {{base_load / nullif(total_kwh, 0)}} AS base_load_ratio FROM pstat')
def _(fx):
    return prof.base_load(prof.profile_totals(fx.profiles())).select(ID, DAY, "base_load", "base_load_ratio")


@query("day_night_ratio_hours", 'SELECT "LCLid", day, {{day_sum / nullif(night_sum, 0)}} AS day_night_hours FROM pstat')
def _(fx):
    return prof.day_night_ratio_hours(fx.profiles()).drop(PROFILE)


@query("row_cv", 'SELECT "LCLid", day, {{CASE WHEN mean_kwh > 0 THEN std1_kwh / mean_kwh ELSE 0 END}} AS calculated_variability FROM pstat')
def _(fx):
    return prof.row_cv(fx.profiles()).drop(PROFILE)


@query(
    "fill_missing_features",
    """SELECT p."LCLid", p.day, p.is_weekday, {{max(std1_kwh)}} AS daily_variability, {{sum(x) FILTER (slot BETWEEN 6 AND 11)}} AS morning_kwh,
    {{sum(x) FILTER (slot BETWEEN 24 AND 35)}} AS afternoon_kwh, {{sum(x) FILTER (slot >= 36)}} AS evening_kwh, {{sum(x) FILTER (slot < 6)}} AS night_kwh,
    {{sum(x)}} AS total_kwh, {{avg(x)}} AS mean_kwh, {{max(std1_kwh)}} AS std_kwh, {{max(x)}} AS peak_kwh
    FROM pcal p JOIN pclean c ON p."LCLid" = c."LCLid" AND p.day = c.day GROUP BY 1, 2, 3""",
)
def _(fx):
    df = cal.calendar_basic(fx.profiles()).select(ID, DAY, PROFILE, "dayofweek")
    return prof.fill_missing_features(df).drop(PROFILE, "dayofweek")


@query(
    "gini",
    """SELECT "LCLid", day, {{sum((2 * i - 49) * x) / nullif(48 * sum(x), 0)}} AS gini FROM (SELECT *, row_number() OVER (PARTITION BY "LCLid", day ORDER BY x) AS i FROM pclean) GROUP BY 1, 2""",
)
def _(fx):
    return prof.gini(fx.profiles()).drop(PROFILE)


_HAVE = {"LCLid", "day", "total_kwh", "dayofweek", "is_weekend", "season", "month", "is_holiday", "temperatureMax", "temperatureMin", "humidity", "is_weekday", "Acorn_grouped", "stdorToU"}
_REPORT = " UNION ALL ".join(
    f"SELECT '{g}' AS category, '{c}' AS \"column\", {int(c in _HAVE)} AS present, "
    + (f'count("{c}")' if c in _HAVE else "count(CASE WHEN false THEN 1 END)")
    + " AS known_rows FROM feat"
    for g, c in [(g, c) for g, cs in EXPECTED_COLUMNS.items() for c in cs] + [("Half-Hourly Columns", c) for c in HH_COLS]
)


@query("column_report", _REPORT)
def _(fx):
    return columns.column_report(fx.features())


# --- weather -----------------------------------------------------------------------------


@query(
    "temp_features",
    """SELECT "LCLid", day, {{temp_range}} AS temp_range, {{temp_avg}} AS temp_avg, {{heating_degree_days}} AS heating_degree_days,
    {{cooling_degree_days}} AS cooling_degree_days FROM feat""",
)
def _(fx):
    return wx.temp_features(fx.merged()).select(ID, DAY, "temp_range", "temp_avg", "heating_degree_days", "cooling_degree_days")


@query(
    "temp_extremes",
    """SELECT "LCLid", day, coalesce(temp_avg < 5, false)::int AS is_very_cold, coalesce(temp_avg > 25, false)::int AS is_very_hot FROM feat""",
)
def _(fx):
    return wx.temp_extremes(wx.temp_features(fx.merged())).select(ID, DAY, "is_very_cold", "is_very_hot")


@query(
    "humidity_cloud_flags",
    """SELECT "LCLid", day, coalesce(humidity > 0.8e0, false)::int AS is_high_humidity, coalesce(humidity < 0.3e0, false)::int AS is_low_humidity,
    coalesce("cloudCover" > 0.7e0, false)::int AS is_cloudy, coalesce("cloudCover" < 0.3e0, false)::int AS is_clear FROM merged""",
)
def _(fx):
    return wx.humidity_cloud_flags(fx.merged()).select(ID, DAY, "is_high_humidity", "is_low_humidity", "is_cloudy", "is_clear")


@query(
    "wind_quantile_flags",
    """SELECT "LCLid", day, coalesce("windSpeed" > q[2], false)::int AS is_windy, coalesce("windSpeed" < q[1], false)::int AS wind_calm
    FROM merged, (SELECT quantile_cont("windSpeed", [0.25, 0.75]) AS q FROM merged)""",
)
def _(fx):
    return wx.wind_quantile_flags(fx.merged()).select(ID, DAY, "is_windy", "wind_calm")


def _corr_sql(t: str) -> str:
    return f"""(SELECT "LCLid", covar_pop(total_kwh, {t}) / nullif(stddev_pop(total_kwh) * stddev_pop({t}), 0) AS r FROM feat WHERE {t} IS NOT NULL GROUP BY 1)"""


@query(
    "temp_sensitivity",
    f'SELECT m."LCLid", m.day, {{{{r}}}} AS temp_sensitivity FROM feat m LEFT JOIN {_corr_sql("temp_avg")} c ON m."LCLid" = c."LCLid"',
)
def _(fx):
    return wx.temp_sensitivity(wx.temp_features(fx.merged())).select(ID, DAY, "temp_sensitivity")


@query(
    "temp_impact",
    f"""SELECT m."LCLid", m.day, {{{{r}}}} AS temp_impact FROM feat m LEFT JOIN {_corr_sql('"temperatureMax"')} c ON m."LCLid" = c."LCLid" """,
)
def _(fx):
    return wx.temp_impact(fx.merged()).select(ID, DAY, "temp_impact")


@query(
    "season_weather_need",
    """SELECT "LCLid", day, {{CASE WHEN season = 'Winter' THEN 1 ELSE 0 END * heating_degree_days}} AS winter_heating_need,
    {{CASE WHEN season = 'Summer' THEN 1 ELSE 0 END * cooling_degree_days}} AS summer_cooling_need FROM feat""",
)
def _(fx):
    return wx.season_weather_need(wx.temp_features(fx.merged())).select(ID, DAY, "winter_heating_need", "summer_cooling_need")


@query(
    "weather_interactions",
    """SELECT "LCLid", day, {{is_weekend * heating_degree_days}} AS weekend_heating, {{is_weekday * heating_degree_days}} AS weekday_heating,
    {{is_summer * cooling_degree_days}} AS summer_cooling, {{is_holiday * total_kwh}} AS holiday_consumption_boost FROM feat""",
)
def _(fx):
    return wx.weather_interactions(fx.features()).select(
        ID, DAY, "weekend_heating", "weekday_heating", "summer_cooling", "holiday_consumption_boost"
    )


@query("feature_table", f'SELECT "LCLid", day, {ftab_columns()} FROM ftab')
def _(fx):
    return fx.feature_table()
