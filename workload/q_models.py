"""Decomposition, training, driver analysis and forecast evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions import calendar as cal
from wattloom.operators import columns, drivers, panel, splits
from wattloom.operators import evaluate as ev
from wattloom.plans import feature_table as plans
from wattloom.plans import forecasting, training
from wattloom.schema import DAY, ID

from .base import query
from .fixtures import COEFS, INTERCEPT, three_way

LAGS = ["lag1_total", "lag7_total", "lag14_total", "roll7_total_mean", "roll14_total_mean"]


@query(
    "seasonal_decompose",
    """WITH t AS (SELECT *, isodow(day) AS dow, avg(total_kwh) OVER (PARTITION BY "LCLid" ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM meter),
    e AS (SELECT "LCLid", dow, avg(total_kwh - trend) AS e FROM t GROUP BY 1, 2), s AS (SELECT *, e - avg(e) OVER (PARTITION BY "LCLid") AS seasonal FROM e)
    SELECT t."LCLid", day, {{total_kwh}} AS observed, {{trend}} AS trend, {{seasonal}} AS seasonal, {{total_kwh - trend - seasonal}} AS remainder
    FROM t JOIN s ON t."LCLid" = s."LCLid" AND t.dow = s.dow""",
)
def _(fx):
    return training.seasonal_decompose(fx.meter())


@query(
    "seasonal_decompose_city",
    """WITH d AS (SELECT day, sum(total_kwh) AS kwh FROM meter GROUP BY 1),
    t AS (SELECT *, isodow(day) AS dow, avg(kwh) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM d),
    e AS (SELECT dow, avg(kwh - trend) AS e FROM t GROUP BY 1), s AS (SELECT *, e - avg(e) OVER () AS seasonal FROM e)
    SELECT 'city' AS city, day, {{kwh}} AS observed, {{trend}} AS trend, {{seasonal}} AS seasonal, {{kwh - trend - seasonal}} AS remainder FROM t JOIN s ON t.dow = s.dow""",
)
def _(fx):
    daily = fx.meter().groupBy(DAY).agg(F.sum("total_kwh").alias("kwh")).withColumn("city", F.lit("city"))
    return training.seasonal_decompose(daily, "kwh", "city")


# --- training ------------------------------------------------------------------------------


def _train_frame(fx, label="label_1"):
    df = cal.calendar_basic(panel.panel_safe(fx.meter()))
    df = panel.label_day_ahead(df)
    df = df.withColumn("cluster", three_way(F.col("total_kwh"), 20, 35))
    return splits.split_by_date(df)


FEATS = [*LAGS, "dayofweek", "month"]
# fixed coefficients of the linear scorer used by the study queries
STUDY = training.LinearScorer(
    {"lag1_total": 0.3, "lag7_total": 0.2, "lag14_total": 0.1, "roll7_total_mean": 0.15, "roll14_total_mean": 0.05, "dayofweek": -0.5, "month": 0.25}, 4.0
)
RECURSIVE = training.LinearScorer({"lag1_total": 0.4, "lag7_total": 0.2, "lag14_total": 0.1, "roll7_total_mean": 0.15, "roll14_total_mean": 0.1}, 1.0)


def _linear(scorer, name="{}") -> str:
    return " + ".join([f"{scorer.intercept}e0", *[f"{b}e0 * {name.format(c)}" for c, b in scorer.coefs.items()]])


_FRAME = """SELECT l."LCLid", l.day, l.lag1_total, l.lag7_total, l.lag14_total, l.roll7_total_mean, l.roll14_total_mean, l.dayofweek, l.month, l.total_kwh,
    lead(l.total_kwh) OVER (PARTITION BY l."LCLid" ORDER BY l.day) AS label_1 FROM lagged l"""
_LABELLED = f"SELECT * FROM ({_FRAME}) WHERE label_1 IS NOT NULL"
_WHOLE = f"SELECT * FROM ({_LABELLED}) WHERE lag14_total IS NOT NULL"


@query("train_boosted_trees")
def _(fx):
    df = _train_frame(fx).persist()
    model = training.fit_boosted_trees(df, FEATS, "label_1", {"maxDepth": 4}, rounds=20)
    out = training.score_splits(model, df, "label_1")
    return ev.metrics_by_split(out)


@query("tune_boosted_trees")
def _(fx):
    best, trials = training.tune_boosted_trees(_train_frame(fx), FEATS, "label_1")
    rows = [(t["trial"], str(t["params"]), t["rounds"], float(t["rmse"]) if t["rmse"] is not None else None, t["params"] is best) for t in trials]
    return fx.spark.createDataFrame(rows, "trial int, params string, rounds int, rmse double, best boolean")


def _job(fx, prepare):
    prepared = prepare(fx.feature_table())
    _, scored = forecasting.forecast(prepared, params={"maxDepth": 4})
    return scored


@query("forecast_day_ahead")
def _(fx):
    return _job(fx, plans.prepare_day_ahead)


@query("forecast_week_ahead")
def _(fx):
    return _job(fx, plans.prepare_week_ahead)


@query("train_per_cluster")
def _(fx):
    pred = forecasting.per_cluster(_train_frame(fx), FEATS, "label_1", [0, 1, 2], params={"maxDepth": 3}, rounds=10)
    return ev.compare_models(pred, ["model", "cluster", "split"])


@query(
    "score_splits",
    f"""SELECT "LCLid", day, split, {{{{label_1}}}} AS y_true, {{{{{_linear(STUDY)}}}}} AS y_pred FROM (
      SELECT *, CASE WHEN day > max(day) OVER () - 90 THEN 'test' WHEN day > max(day) OVER () - 120 THEN 'val' ELSE 'train' END AS split FROM ({_LABELLED}))""",
)
def _(fx):
    return training.score_splits(STUDY, _train_frame(fx), "label_1")


@query("feature_importance")
def _(fx):
    df = _train_frame(fx).persist()
    model = training.fit_boosted_trees(df, FEATS, "label_1", {"maxDepth": 3}, rounds=10, early_stopping=False)
    df.unpersist()
    return training.feature_importance(model, df, FEATS)


PDP = ["lag1_total", "lag7_total", "lag14_total", "roll7_total_mean", "roll14_total_mean", "month"]


@query(
    "partial_dependence",
    f"""WITH t AS ({_WHOLE}), q AS (SELECT feature, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM t CROSS JOIN LATERAL (
      VALUES {", ".join(f"('{c}', t.{c}::double)" for c in PDP)}) f(feature, v) GROUP BY 1),
    p AS (SELECT feature, g::int AS grid_index, lo + g * ((hi - lo) / 9) AS grid_value FROM q, range(10) r(g)),
    m AS (SELECT avg({_linear(STUDY)}) AS mean, {", ".join(f"avg({c}) AS {c}" for c in PDP)} FROM t)
    SELECT feature, grid_index, {{{{grid_value}}}} AS grid_value, {{{{mean + CASE feature {" ".join(f"WHEN '{c}' THEN {STUDY.coefs[c]}e0 * (grid_value - m.{c})" for c in PDP)} END}}}} AS mean_prediction FROM p, m""",
)
def _(fx):
    return training.partial_dependence(STUDY, _train_frame(fx).na.drop(subset=LAGS), PDP)


@query(
    "permutation_importance",
    f"""WITH t AS (SELECT *, md5(concat_ws('|', '42', "LCLid", day::varchar)) AS h FROM ({_WHOLE})),
    b AS (SELECT *, ('0x' || substr(h, 1, 8))::bigint % 64 AS bin FROM t),
    d AS (SELECT *, {_linear(STUDY)} AS p, {", ".join(f"coalesce(lead({c}) OVER w, first_value({c}) OVER w) AS d_{c}" for c in FEATS)}
      FROM b WINDOW w AS (PARTITION BY bin ORDER BY h, "LCLid", day)),
    e AS (SELECT feature, sqrt(avg((p + delta - label_1) ** 2)) AS rmse FROM d CROSS JOIN LATERAL (
      VALUES {", ".join(f"('{c}', {STUDY.coefs[c]}e0 * (d.d_{c} - d.{c}))" for c in FEATS)}) f(feature, delta) GROUP BY 1)
    SELECT feature, {{{{rmse}}}} AS rmse, {{{{rmse - (SELECT sqrt(avg((p - label_1) ** 2)) FROM d)}}}} AS rmse_rise FROM e""",
)
def _(fx):
    return training.permutation_importance(STUDY, _train_frame(fx), FEATS, "label_1", bins=64)


_RING = _linear(RECURSIVE, "{}").replace("lag14_total", "l[1]").replace("lag7_total", "l[8]").replace("lag1_total", "l[14]")
_RING = _RING.replace("roll7_total_mean", "list_aggregate(l[8:14], 'avg')").replace("roll14_total_mean", "list_aggregate(l, 'avg')")


@query(
    "recursive_forecast",
    f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY "LCLid" ORDER BY day DESC) AS k FROM meter),
    s AS (SELECT "LCLid", max(day) AS day, list(total_kwh ORDER BY day) AS v FROM r WHERE k <= 14 GROUP BY 1),
    f AS (SELECT "LCLid", day, 0 AS step, list_concat([NULL::double FOR i IN range(14 - len(v))], v) AS l, NULL::double AS y_pred FROM s
      UNION ALL SELECT "LCLid", (day + 1)::date, step + 1, list_concat(l[2:14], [{_RING}]), {_RING} FROM f WHERE step < 3)
    SELECT "LCLid", day, step::int AS step, {{{{y_pred}}}} AS y_pred FROM f WHERE step > 0""",
)
def _(fx):
    return training.recursive_forecast(RECURSIVE, fx.meter(), 3)


PRUNE = [*LAGS, "month", "day_of_year", "temp_avg", "heating_degree_days"]
_PAIRS = [(a, b) for i, a in enumerate(PRUNE) for b in PRUNE[i + 1 :]]


@query(
    "pair_correlations",
    "SELECT a, b, rows, {{r}} AS r FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS rows, corr({a}, {b}) AS r FROM lagged" for a, b in _PAIRS)
    + ")",
)
def _(fx):
    return training.pair_correlations(fx.lagged(), PRUNE)


@query(
    "prune_correlated",
    "WITH RECURSIVE c AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT {PRUNE.index(a)} AS i, {PRUNE.index(b)} AS j, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lagged" for a, b in _PAIRS)
    + """),
    s AS (SELECT 0 AS i, []::int[] AS gone UNION ALL
      SELECT i + 1, CASE WHEN list_contains(gone, s.i) THEN gone ELSE list_concat(gone, (SELECT coalesce(list(c.j), []) FROM c WHERE c.i = s.i AND abs(c.r) > 0.9)) END FROM s WHERE i < 9)
    SELECT a AS kept, b AS dropped, {{r}} AS r FROM c JOIN s ON s.i = c.i WHERE abs(r) > 0.9 AND NOT list_contains(s.gone, c.i)""",
)
def _(fx):
    _, pairs = training.prune_correlated(fx.lagged(), PRUNE, 0.9)
    return pairs


@query("driver_report")
def _(fx):
    df = splits.split_by_date_position(fx.stored_input())
    feats = list(COEFS)
    return training.driver_report(df, feats, "total_kwh", columns.feature_groups(feats, "dated_study"))


_C = {c: f"{b}e0" for c, b in COEFS.items()}


@query(
    "driver_report_fixed",
    f"""WITH d AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS k FROM (SELECT DISTINCT day FROM lagged WHERE lag7_total IS NOT NULL)),
    t AS (SELECT l.* FROM lagged l JOIN d ON l.day = d.day WHERE lag7_total IS NOT NULL AND k <= 90),
    p AS (SELECT *, total_kwh AS y_true, {INTERCEPT}e0 + {" + ".join(f"{b} * {c}" for c, b in _C.items())} AS y_pred FROM t),
    m AS (SELECT {", ".join(f"avg({c}) AS m_{c}" for c in COEFS)} FROM t),
    i AS (SELECT feature, avg(abs(v)) AS importance FROM t, m CROSS JOIN LATERAL (VALUES {", ".join(f"('{c}', {b} * (t.{c} - m.m_{c}))" for c, b in _C.items())}) f(feature, v) GROUP BY 1),
    s AS (SELECT {{{{avg(abs(y_pred - y_true))}}}} AS mae, {{{{sqrt(avg((y_pred - y_true) ** 2))}}}} AS rmse, 1 - sum((y_pred - y_true) ** 2) / nullif(var_pop(y_true) * count(*), 0) AS q,
      {{{{avg(abs(y_pred - y_true) / abs(y_true)) FILTER (y_true <> 0) * 100}}}} AS mape, {{{{avg(y_true)}}}} AS avg_consumption, {{{{avg(abs(y_pred - y_true)) / avg(y_true) * 100}}}} AS relative_error FROM p)
    SELECT 'test' AS split, mae, rmse, {{{{q}}}} AS r2, mape, {{{{q * 100}}}} AS variance_explained, avg_consumption, relative_error,
    CASE WHEN q > 0.95 THEN 'EXCELLENT' WHEN q > 0.80 THEN 'GOOD' ELSE 'FAIR' END AS model_quality,
    (SELECT feature FROM i ORDER BY importance DESC, feature LIMIT 1) AS top_driver,
    (SELECT CASE WHEN feature IN ('is_weekend', 'month') THEN 'calendar' ELSE 'past_use' END AS g FROM i GROUP BY 1 ORDER BY avg(importance) DESC, g LIMIT 1) AS top_group,
    5 AS total_features, 2 AS feature_groups FROM s""",
)
def _(fx):
    df = splits.split_by_date_position(fx.stored_input())
    scorer = training.LinearScorer(COEFS, INTERCEPT)
    return training.driver_report(df, list(COEFS), "total_kwh", {"past_use": ["lag1_total", "lag7_total", "roll7_total_mean"], "calendar": ["is_weekend", "month"]}, scorer)


# --- baselines and bias -------------------------------------------------------------------


@query("naive_forecast", 'SELECT "LCLid", day, split, cluster, model, {{y_true}} AS y_true, {{y_pred}} AS y_pred FROM preds')
def _(fx):
    return fx.predictions()


def _bias(on: str) -> str:
    return f"""SELECT "LCLid", day, {{{{y_pred - (SELECT avg(y_pred - y_true) FROM pred1 WHERE split = '{on}')}}}} AS y_pred_corrected FROM pred1"""


@query("bias_correction", _bias("val"))
def _(fx):
    return ev.bias_correction(fx.prediction1()).select(ID, DAY, "y_pred_corrected")


@query("bias_correction_on_test", _bias("test"))
def _(fx):
    return ev.bias_correction(fx.prediction1(), on="test").select(ID, DAY, "y_pred_corrected")


# --- contributions --------------------------------------------------------------------------

_BASE = " + ".join(f"{b}e0 * (SELECT avg({c}) FROM cin)" for c, b in COEFS.items())


@query(
    "contributions",
    f"""SELECT "LCLid", day, feature, {{{{feature_value}}}} AS feature_value, {{{{contribution}}}} AS contribution, {{{{b}}}} AS base_value
    FROM contrib, (SELECT {INTERCEPT}e0 + {_BASE} AS b)""",
)
def _(fx):
    return fx.contributions().drop("cluster")


_RANK = "(SELECT feature, avg(abs(contribution)) AS importance FROM contrib GROUP BY 1)"


@query(
    "global_driver_ranking",
    f"""SELECT feature, {{{{importance}}}} AS importance, (row_number() OVER (ORDER BY importance DESC, feature))::int AS rank,
    {{{{importance / sum(importance) OVER () * 100}}}} AS contribution_pct FROM {_RANK}""",
)
def _(fx):
    return drivers.global_driver_ranking(fx.contributions())


@query(
    "importance_rank",
    f"""SELECT feature, rank FROM (SELECT feature, (row_number() OVER (ORDER BY importance DESC, feature))::int AS rank FROM {_RANK}) WHERE rank <= 3""",
)
def _(fx):
    return drivers.global_driver_ranking(fx.contributions(), top_k=3).select("feature", "rank")


GROUPS = {"past_use": ["lag1_total", "lag7_total", "roll7_total_mean"], "calendar": ["is_weekend", "month"]}


@query(
    "group_importance",
    """WITH c AS (SELECT abs(contribution) AS a, CASE WHEN feature IN ('is_weekend', 'month') THEN 'calendar' ELSE 'past_use' END AS g, feature FROM contrib)
    SELECT g AS "group", {{i}} AS importance, {{i / (SELECT avg(a) FROM c) * 100}} AS contribution_pct, {{s / (SELECT sum(a) FROM c) * 100}} AS share_pct, k AS feature_count,
    {{i / k}} AS avg_per_feature, (row_number() OVER (ORDER BY i DESC, g))::int AS rank FROM (SELECT g, avg(a) AS i, sum(a) AS s, count(DISTINCT feature) AS k FROM c GROUP BY 1)""",
)
def _(fx):
    return drivers.group_importance(fx.contributions(), GROUPS)


@query(
    "local_insights",
    f"""WITH r AS (SELECT "LCLid", day, row_number() OVER (ORDER BY "LCLid", day) - 1 AS k, count(*) OVER () AS n FROM cin),
    p AS (SELECT c."LCLid", c.day, feature, feature_value, contribution, row_number() OVER (PARTITION BY c."LCLid", c.day ORDER BY contribution DESC, feature) AS u,
      row_number() OVER (PARTITION BY c."LCLid", c.day ORDER BY contribution, feature) AS d, sum(contribution) OVER (PARTITION BY c."LCLid", c.day) AS t
      FROM contrib c JOIN r ON c."LCLid" = r."LCLid" AND c.day = r.day WHERE k IN (0, (n - 1) // 2, n - 1))
    SELECT "LCLid", day, feature, {{{{feature_value}}}} AS feature_value, {{{{contribution}}}} AS contribution, u::int AS rank_up, d::int AS rank_down, {{{{t}}}} AS total_impact,
    {{{{t + {INTERCEPT}e0 + {_BASE}}}}} AS predicted FROM p WHERE u <= 2 OR d <= 2""",
)
def _(fx):
    contrib = drivers.contributions(fx.stored_input(), COEFS, INTERCEPT)
    return drivers.local_insights(contrib, k=3, top=2)


@query(
    "contributions_by_cluster",
    "SELECT cluster, feature, {{avg(abs(contribution))}} AS importance, {{avg(contribution)}} AS mean_contribution FROM contrib GROUP BY 1, 2",
)
def _(fx):
    return drivers.contributions_by_cluster(fx.contributions())


@query(
    "dependence_points",
    """SELECT "LCLid", day, {{max(feature_value) FILTER (feature = 'lag1_total')}} AS feature_value, {{max(contribution) FILTER (feature = 'lag1_total')}} AS contribution,
    {{max(feature_value) FILTER (feature = 'month')}} AS interaction_value FROM contrib GROUP BY 1, 2""",
)
def _(fx):
    return drivers.dependence_points(fx.contributions(), "lag1_total", "month")


# --- evaluation ---------------------------------------------------------------------------

_R2 = "1 - sum((y_pred - y_true) ** 2) / nullif(var_pop(y_true) * count(*), 0)"
_M = f"""{{{{avg(abs(y_pred - y_true))}}}} AS mae, {{{{sqrt(avg((y_pred - y_true) ** 2))}}}} AS rmse,
    {{{{avg(abs(y_pred - y_true) / abs(y_true)) FILTER (y_true <> 0) * 100}}}} AS mape, {{{{{_R2}}}}} AS r2, {{{{avg(y_pred - y_true)}}}} AS bias"""


@query("forecast_metrics", f"SELECT {_M} FROM pred1")
def _(fx):
    return ev.forecast_metrics(fx.prediction1())


@query("metrics_by_split", f"SELECT split, {_M} FROM pred1 GROUP BY 1")
def _(fx):
    return ev.metrics_by_split(fx.prediction1())


_SMAPE = "avg(CASE WHEN abs(y_true) + abs(y_pred) > 0 THEN abs(y_pred - y_true) / ((abs(y_true) + abs(y_pred)) / 2) END) * 100"


@query(
    "metrics_by_cluster",
    f"""SELECT cluster, round(avg(abs(y_pred - y_true)), 4) + 0e0 AS mae, round(sqrt(avg((y_pred - y_true) ** 2)), 4) + 0e0 AS rmse, round({_R2}, 4) + 0e0 AS r2,
    round(avg(abs(y_pred - y_true) / y_true) FILTER (y_true >= 0.1) * 100, 2) + 0e0 AS mape, round({_SMAPE}, 2) + 0e0 AS smape, count(*) AS samples FROM pred1 GROUP BY 1""",
)
def _(fx):
    return ev.metrics_by_cluster(fx.prediction1())


def _one(df, keys=(), **cols):
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()])


@query("mape_clipped", "SELECT split, {{avg(abs(y_pred - y_true) / y_true) FILTER (y_true >= 0.1) * 100}} AS mape FROM pred1 GROUP BY 1")
def _(fx):
    return _one(fx.prediction1(), ["split"], mape=ev.mape(0.1))


@query("smape", f"SELECT split, {{{{{_SMAPE}}}}} AS smape FROM pred1 GROUP BY 1")
def _(fx):
    return _one(fx.prediction1(), ["split"], smape=ev.smape())


@query("mape_floor", "SELECT split, {{avg(abs(y_pred - y_true) / greatest(y_true, 1e-6)) * 100}} AS mape FROM pred1 GROUP BY 1")
def _(fx):
    return _one(fx.prediction1(), ["split"], mape=ev.mape_floor())


@query("mape_unguarded", "SELECT split, {{avg(abs(y_pred - y_true) / nullif(abs(y_true), 0)) * 100}} AS mape FROM pred1 GROUP BY 1")
def _(fx):
    return _one(fx.prediction1(), ["split"], mape=ev.mape())


@query(
    "peak_metrics",
    f"""SELECT {{{{t}}}} AS threshold, count(*) AS n_samples, {_M} FROM pred1, (SELECT quantile_cont(y_true, 0.9) AS t FROM pred1) WHERE y_true >= t GROUP BY t""",
)
def _(fx):
    return ev.peak_metrics(fx.prediction1())


@query(
    "residual_rows",
    """SELECT "LCLid", day, {{y_pred - y_true}} AS residual, {{abs(y_pred - y_true)}} AS abs_residual, {{abs((y_pred - y_true) / nullif(y_true, 0)) * 100}} AS pct_error,
    {{(rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1) / 2e0) / count(*) OVER () * 100}} AS pct_true_rank FROM pred1""",
)
def _(fx):
    return ev.residual_rows(fx.prediction1()).select(ID, DAY, "residual", "abs_residual", "pct_error", "pct_true_rank")


@query(
    "residual_summary",
    """SELECT {{avg(r)}} AS mean_residual, {{quantile_cont(r, 0.5)}} AS median_residual, {{stddev_pop(r)}} AS std_residual, {{quantile_cont(r, 0.05)}} AS p5_residual,
    {{quantile_cont(r, 0.95)}} AS p95_residual, {{avg(abs(r))}} AS mean_abs_residual, {{quantile_cont(abs(r), 0.5)}} AS median_abs_residual,
    {{avg(abs(r / nullif(y_true, 0)) * 100)}} AS mean_pct_error FROM (SELECT *, y_pred - y_true AS r FROM pred1)""",
)
def _(fx):
    return ev.residual_summary(fx.prediction1())


_PERF = f"""SELECT split, {{{{avg(abs(y_pred - y_true))}}}} AS mae, {{{{sqrt(avg((y_pred - y_true) ** 2))}}}} AS rmse, {{{{{_R2}}}}} AS r2,
    {{{{avg(abs(y_pred - y_true) / abs(y_true)) FILTER (y_true <> 0) * 100}}}} AS mape, {{{{({_R2}) * 100}}}} AS variance_explained, {{{{avg(y_true)}}}} AS avg_consumption,
    {{{{avg(abs(y_pred - y_true)) / avg(y_true) * 100}}}} AS relative_error FROM pred1 GROUP BY 1"""


@query("driver_performance", _PERF)
def _(fx):
    return ev.driver_performance(fx.prediction1())


@query(
    "model_quality_label",
    f"""SELECT split, CASE WHEN r2 > 0.95 THEN 'EXCELLENT' WHEN r2 > 0.80 THEN 'GOOD' ELSE 'FAIR' END AS model_quality FROM (SELECT split, {_R2} AS r2 FROM pred1 GROUP BY 1)""",
)
def _(fx):
    return ev.model_quality_label(ev.metrics_by_split(fx.prediction1())).select("split", "model_quality")


@query("compare_models", f"SELECT model, {_M} FROM preds GROUP BY 1")
def _(fx):
    return ev.compare_models(fx.predictions())


@query(
    "actual_vs_predicted",
    """SELECT "LCLid", day, split, cluster, {{y_true}} AS y_true, {{y_pred}} AS y_pred, {{y_pred - y_true}} AS residual FROM pred1
    WHERE "LCLid" IN (SELECT "LCLid" FROM (SELECT DISTINCT "LCLid" FROM pred1) ORDER BY md5("LCLid"), "LCLid" LIMIT 3)""",
)
def _(fx):
    return ev.actual_vs_predicted(fx.prediction1())


@query("metrics_mse", "SELECT model, {{avg((y_pred - y_true) ** 2)}} AS mse, {{avg(abs(y_pred - y_true))}} AS mae FROM preds GROUP BY 1")
def _(fx):
    return _one(fx.predictions(), ["model"], mse=ev.mse(), mae=ev.mae())


@query("r2_eps", "SELECT split, {{1 - sum((y_pred - y_true) ** 2) / (var_pop(y_true) * count(*) + 1e-7)}} AS r2 FROM pred1 GROUP BY 1")
def _(fx):
    return _one(fx.prediction1(), ["split"], r2=ev.r2(1e-7))


@query("aggregate_metrics", f"SELECT {_M} FROM (SELECT day, sum(y_true) AS y_true, sum(y_pred) AS y_pred FROM pred1 GROUP BY 1)")
def _(fx):
    return ev.aggregate_metrics(fx.prediction1())


