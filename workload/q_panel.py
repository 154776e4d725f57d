"""Lags, rolling windows, labels, sequences, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.operators import columns, encode, panel, quantiles, splits
from wattloom.plans import feature_table as ft
from wattloom.schema import DAY, ID
from wattloom.session import scratch_path

from .base import query
from .oracle import FTAB_DOUBLE, FTAB_EXACT, ftab_columns, half_way_shift

W = 'WINDOW w AS (PARTITION BY "LCLid" ORDER BY day)'


def _roll(fn: str, n: int, upto: str, frm: int) -> str:
    return f'{fn}(total_kwh) OVER (PARTITION BY "LCLid" ORDER BY day ROWS BETWEEN {frm} PRECEDING AND {upto})'


def _r(df, *cols):
    return df.select(ID, DAY, *cols)


@query(
    "lags_safe",
    f"""SELECT "LCLid", day, {{{{total_kwh}}}} AS total_kwh, {{{{lag(total_kwh, 1) OVER w}}}} AS lag1_total, {{{{lag(total_kwh, 7) OVER w}}}} AS lag7_total,
    {{{{lag(total_kwh, 14) OVER w}}}} AS lag14_total FROM meter {W}""",
)
def _(fx):
    return panel.lags_safe(fx.meter())


@query(
    "rolling_mean_safe",
    f"""SELECT "LCLid", day, {{{{{_roll("avg", 7, "1 PRECEDING", 7)}}}}} AS roll7_total_mean, {{{{{_roll("avg", 14, "1 PRECEDING", 14)}}}}} AS roll14_total_mean FROM meter""",
)
def _(fx):
    return panel.rolling_mean_safe(fx.meter()).drop("total_kwh")


@query(
    "delta_safe",
    f"""SELECT "LCLid", day, {{{{coalesce(l1 - l2, 0)}}}} AS delta1_total, {{{{CASE WHEN abs(l2) > 0 THEN (l1 - l2) / (l2 + 1e-6) ELSE 0 END}}}} AS pct_change1_total
    FROM (SELECT *, lag(total_kwh, 1) OVER w AS l1, lag(total_kwh, 2) OVER w AS l2 FROM meter {W})""",
)
def _(fx):
    return panel.delta_safe(fx.meter()).drop("total_kwh")


@query(
    "lags_plain",
    f'SELECT "LCLid", day, {{{{lag(total_kwh, 1) OVER w}}}} AS lag1_total, {{{{lag(total_kwh, 7) OVER w}}}} AS lag7_total, {{{{lag(total_kwh, 14) OVER w}}}} AS lag14_total FROM meter {W}',
)
def _(fx):
    return panel.lags_plain(fx.meter()).drop("total_kwh")


@query(
    "rolling_plain",
    f"""SELECT "LCLid", day, {{{{{_roll("avg", 7, "CURRENT ROW", 6)}}}}} AS roll7_total_mean, {{{{{_roll("stddev_samp", 7, "CURRENT ROW", 6)}}}}} AS roll7_total_std,
    {{{{{_roll("avg", 14, "CURRENT ROW", 13)}}}}} AS roll14_total_mean, {{{{{_roll("stddev_samp", 14, "CURRENT ROW", 13)}}}}} AS roll14_total_std FROM meter""",
)
def _(fx):
    return panel.rolling_plain(fx.meter()).drop("total_kwh")


@query(
    "change_plain",
    f"""SELECT "LCLid", day, {{{{total_kwh - l1}}}} AS delta1_total, {{{{(total_kwh - l1) / (l1 + 1e-6)}}}} AS pct_change1_total
    FROM (SELECT *, lag(total_kwh, 1) OVER w AS l1 FROM meter {W})""",
)
def _(fx):
    return panel.change_plain(fx.meter()).drop("total_kwh")


@query("weekly_change", f'SELECT "LCLid", day, {{{{total_kwh - lag(total_kwh, 7) OVER w}}}} AS weekly_change_total FROM meter {W}')
def _(fx):
    return panel.weekly_change(fx.meter()).drop("total_kwh")


def _ext(which: str) -> str:
    lags = ", ".join(f"{{{{lag(total_kwh, {k}) OVER w}}}} AS lag{k}_total" for k in panel.LAG_SETS[which])
    rolls = ", ".join(f"{{{{{_roll('avg', n, '1 PRECEDING', n)}}}}} AS roll{n}_total_mean" for n in panel.WINDOW_SETS[which])
    return f'SELECT "LCLid", day, {lags}, {rolls} FROM meter {W}'


@query("extended_lags", _ext("default"))
def _(fx):
    return panel.extended_lags(fx.meter()).drop("total_kwh")


@query("extended_lags_long", _ext("long"))
def _(fx):
    return panel.extended_lags(fx.meter(), which="long").drop("total_kwh")


@query(
    "interactions_lag",
    """SELECT "LCLid", day, {{coalesce(is_weekend * heating_degree_days * (lag1_total / (lag1_total + 1e-6)), 0)}} AS lag1_weekend_heating,
    {{coalesce(is_holiday * lag1_total, 0)}} AS lag1_holiday_consumption,
    {{coalesce(is_summer * cooling_degree_days * (lag1_total / (lag1_total + 1e-6)), 0)}} AS lag1_summer_cooling FROM lagged""",
)
def _(fx):
    df = panel.interactions_lag(panel.lags_safe(fx.features()))
    return _r(df, "lag1_weekend_heating", "lag1_holiday_consumption", "lag1_summer_cooling")


def _label(h: int) -> str:
    return f"""SELECT "LCLid", day, {{{{l}}}} AS label_{h} FROM (SELECT *, lead(total_kwh, {h}) OVER w AS l FROM meter {W}) WHERE l IS NOT NULL"""


@query("label_day_ahead", _label(1))
def _(fx):
    return panel.label_day_ahead(fx.meter()).drop("total_kwh")


@query("label_week_ahead", _label(7))
def _(fx):
    return panel.label_week_ahead(fx.meter()).drop("total_kwh")


@query("label_horizon", _label(30))
def _(fx):
    return panel.label_horizon(fx.meter(), 30).drop("total_kwh")


# Sequences leave as one text per window that spells every value of X.
def _seq_sql(key: str, extra: str, source: str, cols: str) -> str:
    part = ", ".join(f'"{k}"' for k in key.split())
    cell = f"(v[{{}}] + {half_way_shift(4)!r})::decimal(18, 4)::varchar"
    return f"""SELECT {part}, day, {extra} {{{{y}}}} AS y, n::int AS steps, array_to_string(list_transform(xs, lambda v: {cell.format(1)} || ',' || {cell.format(2)}), ';') AS x
    FROM (SELECT *, total_kwh AS y, list([total_kwh, "temperatureMax"]) OVER p AS xs, count("temperatureMax") OVER p AS n FROM {source}
      WINDOW p AS (PARTITION BY {part} ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)) WHERE n = 14"""


def _flat(df, *extra):
    keys = [c for c in df.columns if c not in ("X", "y", DAY, *extra)]
    text = F.transform("X", lambda v: F.concat_ws(",", *[(v[i] + half_way_shift(4)).cast("decimal(18,4)").cast("string") for i in range(2)]))
    return df.select(*keys, DAY, *extra, "y", F.size("X").alias("steps"), F.array_join(text, ";").alias("x"))


_SEQ = ["total_kwh", "temperatureMax"]


@query("sequences", _seq_sql("LCLid", "", "merged", ""))
def _(fx):
    return _flat(panel.sequences(fx.merged(), _SEQ, "total_kwh"))


@query(
    "sequences_with_cluster",
    _seq_sql("LCLid", "household_code, cluster,", """(SELECT c.*, (dense_rank() OVER (ORDER BY c."LCLid") - 1)::int AS household_code,
    CASE WHEN total_kwh < 20 THEN 0 WHEN total_kwh < 35 THEN 1 ELSE 2 END AS cluster FROM merged c)""", ""),
)
def _(fx):
    from .fixtures import three_way

    df = encode.encode_labels(fx.merged(), ID, "household_code").withColumn("cluster", three_way(F.col("total_kwh"), 20, 35))
    return _flat(panel.sequences(df, _SEQ, "total_kwh", extra=["household_code", "cluster"]), "household_code", "cluster")


_SPLIT = """(SELECT *, CASE WHEN day > t THEN 'test' WHEN day > v THEN 'val' ELSE 'train' END AS split FROM
    (SELECT *, max(day) OVER () - {test} AS t, max(day) OVER () - {both} AS v FROM {src}))"""


@query("sequences_all_splits", _seq_sql("LCLid split", "", _SPLIT.format(test=400, both=700, src="merged"), ""))
def _(fx):
    df = splits.split_by_date(fx.merged(), 300, 400)
    return _flat(panel.sequences(df, _SEQ, "total_kwh", keys=[ID, "split"]))


@query("prev_cluster", f'SELECT "LCLid", day, cluster, lag(cluster) OVER w AS prev_cluster FROM clusters {W}')
def _(fx):
    return panel.prev_cluster(fx.clusters()).drop("total_kwh")


@query(
    "pct_rank_true",
    """SELECT "LCLid", day, {{(rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1) / 2e0) / count(*) OVER () * 100}} AS pct_true_rank FROM pred1""",
)
def _(fx):
    return _r(quantiles.pct_rank_true(fx.prediction1(), "y_true"), "pct_true_rank")


@query(
    "household_relatives",
    """SELECT "LCLid", day, {{total_kwh / nullif(avg(total_kwh) OVER w, 0)}} AS daily_vs_hh_avg, {{total_kwh / nullif(max(total_kwh) OVER w, 0)}} AS daily_vs_hh_max
    FROM meter WINDOW w AS (PARTITION BY "LCLid")""",
)
def _(fx):
    return _r(panel.household_relatives(fx.meter()), "daily_vs_hh_avg", "daily_vs_hh_max")


@query(
    "acorn_relatives",
    """SELECT "LCLid", day, {{avg(total_kwh) OVER w}} AS acorn_mean_consumption, {{stddev_samp(total_kwh) OVER w}} AS acorn_variability,
    {{total_kwh / avg(total_kwh) OVER w}} AS household_vs_acorn, {{max(total_kwh) OVER w / avg(total_kwh) OVER w}} AS acorn_peak_ratio,
    {{stddev_samp(total_kwh) OVER h / stddev_samp(total_kwh) OVER w}} AS acorn_relative_variability FROM merged WINDOW w AS (PARTITION BY "Acorn_grouped"), h AS (PARTITION BY "LCLid")""",
)
def _(fx):
    df = panel.acorn_relatives(fx.merged())
    return _r(df, "acorn_mean_consumption", "acorn_variability", "household_vs_acorn", "acorn_peak_ratio", "acorn_relative_variability")


# --- splits --------------------------------------------------------------------------------


def _split_out(df):
    return _r(df, "split")


@query("split_by_date", f'SELECT "LCLid", day, split FROM {_SPLIT.format(test=90, both=120, src="meter")}')
def _(fx):
    return _split_out(splits.split_by_date(fx.meter()))


@query(
    "split_by_date_halfopen",
    """SELECT "LCLid", day, CASE WHEN day >= DATE '2001-08-01' THEN 'test' WHEN day >= DATE '2001-05-01' THEN 'val' ELSE 'train' END AS split FROM meter""",
)
def _(fx):
    return _split_out(splits.split_by_date_halfopen(fx.meter(), "2001-05-01", "2001-08-01"))


_POS = """(SELECT m.*, CASE WHEN k <= 90 THEN 'test' WHEN k <= 120 THEN 'val' ELSE 'train' END AS split FROM {src} m
    JOIN (SELECT day, row_number() OVER (ORDER BY day DESC) AS k FROM (SELECT DISTINCT day FROM meter)) d ON m.day = d.day)"""


@query("split_by_date_position", f'SELECT "LCLid", day, split FROM {_POS.format(src="meter")}')
def _(fx):
    return _split_out(splits.split_by_date_position(fx.meter()))


@query(
    "split_per_household",
    """SELECT "LCLid", day, CASE WHEN r < 90 THEN 'test' WHEN r < 150 THEN 'val' ELSE 'train' END AS split FROM
    (SELECT *, row_number() OVER (PARTITION BY "LCLid" ORDER BY day DESC) AS r, count(*) OVER (PARTITION BY "LCLid") AS n FROM meter) WHERE n >= 150""",
)
def _(fx):
    return _split_out(splits.split_per_household(fx.meter()))


_HASH = """('0x' || substr(md5('42|' || "LCLid" || '|' || cast(day AS varchar)), 1, 8))::bigint % 1000"""


@query("split_random", f"""SELECT "LCLid", day, CASE WHEN {_HASH} < 200 THEN 'test' ELSE 'train' END AS split FROM meter""")
def _(fx):
    return _split_out(splits.split_random(fx.meter()))


@query("sample_households", """SELECT "LCLid" FROM (SELECT DISTINCT "LCLid" FROM meter) ORDER BY md5("LCLid"), "LCLid" LIMIT 10""")
def _(fx):
    return splits.sample_households(fx.meter(), 10)


@query(
    "sample_households_per_cluster",
    """SELECT cluster, "LCLid" FROM (SELECT cluster, "LCLid", row_number() OVER (PARTITION BY cluster ORDER BY md5("LCLid"), "LCLid") AS r
    FROM (SELECT DISTINCT cluster, "LCLid" FROM clusters)) WHERE r <= 20""",
)
def _(fx):
    return splits.sample_households_per_cluster(fx.clusters(), 20)


@query(
    "sample_rows",
    """SELECT "LCLid", day, {{total_kwh}} AS total_kwh FROM meter ORDER BY md5("LCLid" || '|' || cast(day AS varchar)), "LCLid", day LIMIT 1000""",
)
def _(fx):
    return splits.sample_rows(fx.meter(), 1000)


@query(
    "split_summary",
    f"""SELECT split, count(*) AS rows, count(DISTINCT "LCLid") AS households, min(day) AS first_day, max(day) AS last_day FROM {_SPLIT.format(test=90, both=120, src="meter")} GROUP BY 1""",
)
def _(fx):
    return splits.split_summary(splits.split_by_date(fx.meter()))


def _prep_sql(h: int) -> str:
    lab = f'(SELECT *, lead(total_kwh, {h}) OVER (PARTITION BY "LCLid" ORDER BY day) AS label FROM ftab)'
    src = f"(SELECT * FROM {lab} WHERE label IS NOT NULL)"
    return f'SELECT "LCLid", day, split, {{{{label}}}} AS label_{h}, {ftab_columns(("total_kwh",))} FROM {_SPLIT.format(test=90, both=120, src=src)}'


def _prep(p):
    assert "total_kwh" not in p.data.columns and p.target not in p.features
    return p.data.select(ID, DAY, "split", p.target, *p.features)


@query("prepare_day_ahead", _prep_sql(1))
def _(fx):
    return _prep(ft.prepare_day_ahead(fx.feature_table()))


@query("prepare_week_ahead", _prep_sql(7))
def _(fx):
    return _prep(ft.prepare_week_ahead(fx.feature_table()))


_FTAB = [c.strip('"') for c in [*FTAB_EXACT, *FTAB_DOUBLE]]


def _left_out(kind: str) -> tuple[str, ...]:
    return tuple(c for c in _FTAB if c not in columns.study_columns(_FTAB, "total_kwh", kind) and c != "total_kwh")


@query("prepare_driver_analysis", f'SELECT "LCLid", day, split, {ftab_columns(_left_out("dated_study"))} FROM {_POS.format(src="ftab")}')
def _(fx):
    p = ft.prepare_driver_study(fx.feature_table())
    return p.data.select(ID, DAY, "split", "total_kwh", *p.features)


def _stage0_sql() -> str:
    out = _left_out("random_study")
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [*FTAB_EXACT, *FTAB_DOUBLE] if c.strip('"') not in out)
    texts = ('"Acorn"', '"Acorn_grouped"', '"stdorToU"', "season")
    cols = ftab_columns((*out, *[c.strip('"') for c in texts]))
    codes = ", ".join(f"(dense_rank() OVER (ORDER BY {c}) - 1)::int AS {c}" for c in texts)
    return f"""SELECT "LCLid", day, CASE WHEN {_HASH} < 200 THEN 'test' ELSE 'train' END AS split, {codes}, {cols} FROM (SELECT * FROM ftab WHERE {whole})"""


@query("prepare_stage0", _stage0_sql())
def _(fx):
    """The feature table is written first, as the study reads it for the test and for each encoder."""
    features = fx.feature_table()
    path = scratch_path(fx.spark, "features")
    features.write.parquet(path)
    p = ft.prepare_driver_study(fx.spark.read.schema(features.schema).parquet(path), kind="random_study")
    return p.data.select(ID, DAY, "split", "total_kwh", *p.features)


@query("unscale_standard", 'SELECT "LCLid", day, {{total_kwh}} AS kwh FROM meter')
def _(fx):
    """Scaled with the train rows' figures and brought back with them."""
    df = splits.split_by_date(fx.meter())
    train = df.where("split = 'train'")
    scaled = encode.scale_standard(df, ["total_kwh"], F.col("split") == "train")
    return encode.unscale_standard(scaled, "total_kwh_z", train, "total_kwh", "kwh").select(ID, DAY, "kwh")


@query(
    "rolling_origin_folds",
    """WITH d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS p FROM (SELECT DISTINCT day FROM meter)),
    s AS (SELECT count(*) AS n, count(*) // 6 AS size FROM d),
    f AS (SELECT i::int AS fold, n - (6 - i) * size AS a, n - (5 - i) * size AS b FROM s, range(1, 6) t(i))
    SELECT "LCLid", m.day, fold, CASE WHEN p < a - 7 THEN 'train' ELSE 'test' END AS role FROM meter m JOIN d ON m.day = d.day, f WHERE p < a - 7 OR (p >= a AND p < b)""",
)
def _(fx):
    return _r(splits.rolling_origin_folds(fx.meter()), "fold", "role")


