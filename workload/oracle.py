"""DuckDB text of the fixture tables, as common table expressions.

Load profiles are kept long (one row per slot) here, so array rules are checked by plain
aggregates.
"""

from __future__ import annotations

import re

from wattloom.schema import HOLIDAY_CATEGORY, WEATHER_VALUES

_MAP = ", ".join(f"('{k}', '{v}')" for k, v in HOLIDAY_CATEGORY.items())
_SEASON = (
    "CASE WHEN {m} IN (12,1,2) THEN 'Winter' WHEN {m} IN (3,4,5) THEN 'Spring' "
    "WHEN {m} IN (6,7,8) THEN 'Summer' WHEN {m} IN (9,10,11) THEN 'Autumn' ELSE 'Unknown' END"
)
MAC = "concat('MAC', lpad(cast({} AS varchar), 6, '0'))"


def _fill_time(c: str) -> str:
    back = "OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    d = f"CASE WHEN {c} IS NOT NULL THEN day END"
    return (
        f"last_value({c} IGNORE NULLS) {back} AS b_{c}, first_value({c} IGNORE NULLS) {ahead} AS a_{c}, "
        f"last_value({d} IGNORE NULLS) {back} AS bd_{c}, first_value({d} IGNORE NULLS) {ahead} AS ad_{c}"
    )


def _filled(c: str) -> str:
    return (
        f"coalesce({c}, b_{c} + (a_{c} - b_{c}) * date_diff('day', bd_{c}, day) "
        f"/ nullif(date_diff('day', bd_{c}, ad_{c}), 0)::double, b_{c}, a_{c}) AS {c}"
    )


CTES = {
    "meter": f"""SELECT {MAC.format('l_suppkey')} AS "LCLid", cast(l_shipdate AS date) AS day,
        sum(l_quantity)::double AS total_kwh FROM lineitem GROUP BY 1, 2""",
    "household": f"""SELECT {MAC.format('s_suppkey')} AS "LCLid", n_name AS "Acorn", r_name AS "Acorn_grouped",
        CASE WHEN s_acctbal < 2000 THEN 'ToU' ELSE 'Std' END AS "stdorToU"
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "wraw": """SELECT o_orderdate + (o_orderkey % 2) * INTERVAL 1 HOUR AS time,
        25 - abs(dayofyear(o_orderdate) - 200) / 10e0 + count(*) % 5 AS "temperatureMax",
        25 - abs(dayofyear(o_orderdate) - 200) / 10e0 + count(*) % 5 - 4 - count(*) % 4 AS "temperatureMin",
        CASE WHEN sum(o_orderkey)::bigint % 13 <> 0 THEN 0.2e0 + (sum(o_orderkey)::bigint % 80) / 100e0 END AS humidity,
        (sum(o_custkey)::bigint % 100) / 10e0 AS "windSpeed",
        CASE WHEN sum(o_custkey)::bigint % 11 <> 0 THEN (sum(o_custkey)::bigint % 11) / 10e0 END AS "cloudCover"
        FROM orders GROUP BY o_orderdate, o_orderkey % 2""",
    "wday": """SELECT * EXCLUDE (rn) FROM (SELECT cast(time AS date) AS day, *,
        row_number() OVER (PARTITION BY cast(time AS date) ORDER BY time) AS rn FROM wraw) WHERE rn = 1""",
    "wnear": "SELECT *, " + ", ".join(_fill_time(c) for c in WEATHER_VALUES) + " FROM wday",
    "wx": "SELECT day, " + ", ".join(_filled(c) for c in WEATHER_VALUES) + " FROM wnear",
    "hraw": """SELECT DISTINCT cast(o_orderdate AS date) AS "Bank holidays",
        CASE strftime(o_orderdate, '%m-%d') WHEN '12-25' THEN 'Christmas Day' WHEN '12-26' THEN 'Boxing Day'
        WHEN '01-01' THEN 'New Year?s Day' WHEN '05-01' THEN 'Early May bank holiday' ELSE 'Royal Wedding' END AS "Type"
        FROM orders WHERE strftime(o_orderdate, '%m-%d') IN ('12-25', '12-26', '01-01', '05-01', '04-29')""",
    "hmap": f"SELECT * FROM (VALUES {_MAP}) AS t(k, v)",
    "hol": """SELECT "Bank holidays" AS day, "Type" AS holiday_type, coalesce(v, 'Regular Day') AS holiday_category
        FROM hraw LEFT JOIN hmap ON "Type" = k""",
    "merged": f"""SELECT m."LCLid", m.day, m.total_kwh, h."Acorn", h."Acorn_grouped", h."stdorToU",
        {", ".join(f'w."{c}"' for c in WEATHER_VALUES)}, x.holiday_type,
        coalesce(x.holiday_category, 'Regular Day') AS holiday_category, month(m.day)::int AS month,
        {_SEASON.format(m='month(m.day)')} AS season
        FROM meter m LEFT JOIN household h ON m."LCLid" = h."LCLid" LEFT JOIN wx w ON m.day = w.day
        LEFT JOIN hol x ON m.day = x.day""",
    "cal": """SELECT *, dow AS dayofweek, (dow >= 5)::int AS is_weekend, (dow < 5)::int AS is_weekday,
        (dow = 0)::int AS is_monday, (dow = 4)::int AS is_friday, dayofyear(day)::int AS day_of_year,
        (season = 'Winter')::int AS is_winter, (season = 'Summer')::int AS is_summer,
        (season IN ('Spring', 'Autumn'))::int AS is_shoulder_season,
        (holiday_category <> 'Regular Day')::int AS is_holiday
        FROM (SELECT *, (isodow(day) - 1)::int AS dow FROM merged)""",
    "feat": """SELECT *, "temperatureMax" - "temperatureMin" AS temp_range,
        ("temperatureMax" + "temperatureMin") / 2 AS temp_avg,
        CASE WHEN 15 - ("temperatureMax" + "temperatureMin") / 2 < 0 THEN 0e0 ELSE 15 - ("temperatureMax" + "temperatureMin") / 2 END AS heating_degree_days,
        CASE WHEN ("temperatureMax" + "temperatureMin") / 2 - 22 < 0 THEN 0e0 ELSE ("temperatureMax" + "temperatureMin") / 2 - 22 END AS cooling_degree_days
        FROM cal""",
    "readings": """SELECT cast(user_id AS varchar) AS "LCLid", ts, value AS kwh FROM events""",
    "praw": f"""SELECT {MAC.format('n_regionkey')} AS "LCLid", cast(date_trunc('month', l_shipdate) AS date) AS day,
        ((l_orderkey * 7 + l_linenumber) % 48)::int AS slot, sum(l_quantity)::double AS v
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3""",
    "pgrid": """SELECT k."LCLid", k.day, s.slot, p.v FROM (SELECT DISTINCT "LCLid", day FROM praw) k
        CROSS JOIN (SELECT range::int AS slot FROM range(48)) s
        LEFT JOIN praw p ON p."LCLid" = k."LCLid" AND p.day = k.day AND p.slot = s.slot""",
    "pkeep": """SELECT "LCLid", day FROM pgrid GROUP BY 1, 2 HAVING count(*) FILTER (v IS NULL) / 48e0 < 0.2e0""",
    "pnear": """SELECT "LCLid", day, slot, v,
        last_value(v IGNORE NULLS) OVER b AS bv, first_value(v IGNORE NULLS) OVER a AS av,
        last_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER b AS bs,
        first_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER a AS as_
        FROM pgrid WINDOW b AS (PARTITION BY "LCLid", day ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        a AS (PARTITION BY "LCLid", day ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "pfill": """SELECT "LCLid", day, slot,
        coalesce(v, bv + (av - bv) * (slot - bs) / nullif(as_ - bs, 0)::double, bv, av) AS x FROM pnear""",
    "pclean": """SELECT p.* FROM pfill p JOIN pkeep k ON p."LCLid" = k."LCLid" AND p.day = k.day""",
    "pstat": """SELECT "LCLid", day, sum(x) AS total_kwh, avg(x) AS mean_kwh, stddev_pop(x) AS std_kwh,
        max(x) AS peak_kwh, min(x) AS min_kwh, arg_min(slot, (-x, slot))::int AS peak_hour,
        sum(x) FILTER (slot BETWEEN 6 AND 11) AS morning_kwh, sum(x) FILTER (slot BETWEEN 12 AND 17) AS afternoon_kwh,
        sum(x) FILTER (slot BETWEEN 18 AND 23) AS evening_kwh, sum(x) FILTER (slot < 6 OR slot >= 24) AS night_kwh,
        sum(x) FILTER (slot BETWEEN 34 AND 39) AS peak_period_kwh, sum(x) FILTER (slot < 12) AS off_peak_kwh,
        stddev_samp(x) AS std1_kwh, sum(x * x) AS sum_sq, quantile_cont(x, 0.1) AS base_load,
        sum(x) FILTER (slot BETWEEN 12 AND 35) AS day_sum, sum(x) FILTER (slot < 12 OR slot >= 36) AS night_sum
        FROM pclean GROUP BY 1, 2""",
    "pcal": f"""SELECT s.*, (isodow(s.day) - 1)::int AS dayofweek, (isodow(s.day) >= 6)::int AS is_weekend,
        (isodow(s.day) < 6)::int AS is_weekday, month(s.day)::int AS month, {_SEASON.format(m='month(s.day)')} AS season,
        h."Acorn_grouped", h."stdorToU", w."temperatureMax", w.humidity,
        CASE WHEN s.peak_hour < 16 THEN 0 WHEN s.peak_hour < 32 THEN 1 ELSE 2 END AS cluster
        FROM pstat s LEFT JOIN household h ON s."LCLid" = h."LCLid" LEFT JOIN wx w ON s.day = w.day""",
    "clusters": """SELECT *, CASE WHEN total_kwh < 20 THEN 0 WHEN total_kwh < 35 THEN 1 ELSE 2 END AS cluster FROM meter""",
    "fclusters": """SELECT *, CASE WHEN total_kwh < 20 THEN 0 WHEN total_kwh < 35 THEN 1 ELSE 2 END AS cluster FROM feat""",
    "lagged": """SELECT *, lag(total_kwh, 1) OVER w AS lag1_total, lag(total_kwh, 7) OVER w AS lag7_total,
        lag(total_kwh, 14) OVER w AS lag14_total, lag(total_kwh, 2) OVER w AS lag2_total,
        avg(total_kwh) OVER (PARTITION BY "LCLid" ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roll7_total_mean,
        avg(total_kwh) OVER (PARTITION BY "LCLid" ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS roll14_total_mean
        FROM feat WINDOW w AS (PARTITION BY "LCLid" ORDER BY day)""",
    "preds": """SELECT "LCLid", day, cluster, total_kwh AS y_true, y_pred, model,
        CASE WHEN day > t THEN 'test' WHEN day > v THEN 'val' ELSE 'train' END AS split FROM (
          SELECT *, max(day) OVER () - 90 AS t, max(day) OVER () - 120 AS v FROM (
            SELECT *, lag(total_kwh, 1) OVER w AS y_pred, 'lag1' AS model FROM clusters WINDOW w AS (PARTITION BY "LCLid" ORDER BY day)
            UNION ALL
            SELECT *, lag(total_kwh, 7) OVER w AS y_pred, 'lag7' AS model FROM clusters WINDOW w AS (PARTITION BY "LCLid" ORDER BY day)
          ) WHERE y_pred IS NOT NULL)""",
    "pred1": "SELECT * EXCLUDE (model) FROM preds WHERE model = 'lag1'",
    "contrib": """SELECT l."LCLid", l.day, l.cluster, f.feature, f.feature_value, f.feature_value * c.coef - c.coef * avg(f.feature_value) OVER (PARTITION BY f.feature) AS contribution
        FROM cin l CROSS JOIN LATERAL (VALUES ('lag1_total', l.lag1_total), ('lag7_total', l.lag7_total), ('roll7_total_mean', l.roll7_total_mean),
          ('is_weekend', l.is_weekend::double), ('month', l.month::double)) f(feature, feature_value)
        JOIN (VALUES ('lag1_total', 0.3e0), ('lag7_total', 0.2e0), ('roll7_total_mean', 0.25e0), ('is_weekend', -1.5e0), ('month', 0.1e0)) c(feature, coef)
          ON c.feature = f.feature""",
    "cin": """SELECT "LCLid", day, lag1_total, lag7_total, roll7_total_mean, is_weekend, month,
        CASE WHEN total_kwh < 20 THEN 0 WHEN total_kwh < 35 THEN 1 ELSE 2 END AS cluster FROM lagged WHERE lag7_total IS NOT NULL""",
}
CTES["ftab"] = """SELECT l.* EXCLUDE (lag2_total), sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos,
        sin(2 * pi() * dayofweek / 7) AS dayofweek_sin, cos(2 * pi() * dayofweek / 7) AS dayofweek_cos,
        (holiday_category = 'Christmas')::int AS is_christmas, (holiday_category = 'New Year')::int AS is_new_year,
        (holiday_category = 'Bank Holiday')::int AS is_bank_holiday, is_holiday * is_weekday AS holiday_weekday, is_holiday * is_weekend AS holiday_weekend,
        (day - min(day) OVER ())::int AS days_since_start, quarter(day)::int AS quarter, (quarter(day) = 1)::int AS is_q1, (quarter(day) = 4)::int AS is_q4,
        coalesce(lag1_total - lag2_total, 0) AS delta1_total,
        CASE WHEN abs(lag2_total) > 0 THEN (lag1_total - lag2_total) / (lag2_total + 1e-6) ELSE 0e0 END AS pct_change1_total,
        coalesce(temp_avg < 5, false)::int AS is_very_cold, coalesce(temp_avg > 25, false)::int AS is_very_hot,
        coalesce(humidity > 0.8e0, false)::int AS is_high_humidity, coalesce(humidity < 0.3e0, false)::int AS is_low_humidity,
        coalesce("cloudCover" > 0.7e0, false)::int AS is_cloudy, coalesce("cloudCover" < 0.3e0, false)::int AS is_clear,
        coalesce("windSpeed" > q[2], false)::int AS is_windy, coalesce("windSpeed" < q[1], false)::int AS wind_calm, r AS temp_sensitivity,
        CASE WHEN season = 'Winter' THEN 1 ELSE 0 END * heating_degree_days AS winter_heating_need,
        CASE WHEN season = 'Summer' THEN 1 ELSE 0 END * cooling_degree_days AS summer_cooling_need,
        coalesce(is_weekend * heating_degree_days * (lag1_total / (lag1_total + 1e-6)), 0) AS lag1_weekend_heating,
        coalesce(is_holiday * lag1_total, 0) AS lag1_holiday_consumption,
        coalesce(is_summer * cooling_degree_days * (lag1_total / (lag1_total + 1e-6)), 0) AS lag1_summer_cooling
        FROM lagged l LEFT JOIN (SELECT "LCLid" AS k, covar_pop(total_kwh, temp_avg) / nullif(stddev_pop(total_kwh) * stddev_pop(temp_avg), 0) AS r
          FROM feat WHERE temp_avg IS NOT NULL GROUP BY 1) s ON s.k = l."LCLid", (SELECT quantile_cont("windSpeed", [0.25, 0.75]) AS q FROM merged) w"""
# the columns of the feature table: text and whole numbers, then doubles
FTAB_EXACT = (
    '"Acorn" "Acorn_grouped" "stdorToU" holiday_type holiday_category season month dayofweek day_of_year is_weekend is_weekday is_monday is_friday '
    "is_winter is_summer is_shoulder_season is_holiday is_christmas is_new_year is_bank_holiday holiday_weekday holiday_weekend days_since_start quarter "
    "is_q1 is_q4 is_very_cold is_very_hot is_high_humidity is_low_humidity is_cloudy is_clear is_windy wind_calm"
).split()
FTAB_DOUBLE = (
    'total_kwh "temperatureMax" "temperatureMin" humidity "windSpeed" "cloudCover" month_sin month_cos dayofweek_sin dayofweek_cos temp_range temp_avg '
    "heating_degree_days cooling_degree_days lag1_total lag7_total lag14_total roll7_total_mean roll14_total_mean delta1_total pct_change1_total "
    "temp_sensitivity winter_heating_need summer_cooling_need lag1_weekend_heating lag1_holiday_consumption lag1_summer_cooling"
).split()


def ftab_columns(leave_out: tuple[str, ...] = ()) -> str:
    """The select list of the feature table."""
    exact = [c for c in FTAB_EXACT if c.strip('"') not in leave_out]
    return ", ".join([*exact, *[f"{{{{{c}}}}} AS {c}" for c in FTAB_DOUBLE if c.strip('"') not in leave_out]])


_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def _needs(text: str, seen: list[str]) -> None:
    for w in _WORD.findall(text):
        if w in CTES and w not in seen and re.search(rf"(FROM|JOIN|,)\s+{w}\b", text):
            _needs(CTES[w], seen)
            if w not in seen:
                seen.append(w)


def half_way_shift(digits: int) -> float:
    """Far above summation noise, far below the last digit kept."""
    return 3 * 10.0 ** -(digits + 3)


def with_ctes(sql: str, digits: int = 6) -> str:
    """Put the CTEs the text reads in front of it and expand {{x}} to a rounded double."""
    body = re.sub(r"\{\{(.+?)\}\}", lambda m: f"(round(({m.group(1)})::double + {half_way_shift(digits)!r}, {digits}) + 0e0)", sql, flags=re.S)
    used: list[str] = []
    _needs(body, used)
    head = ",\n".join(f"{c} AS ({CTES[c]})" for c in used)
    if not used:
        return body
    joiner = ",\n" if body.lstrip().startswith("WITH ") else "\n"
    rest = body.lstrip()[5:] if joiner == ",\n" else body
    if rest.startswith("RECURSIVE "):
        head, rest = f"RECURSIVE {head}", rest[10:]
    return f"WITH {head}{joiner}{rest}"
