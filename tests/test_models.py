"""Spark ML jobs on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from wattloom.operators import columns, drivers, splits
from wattloom.operators import evaluate as ev
from wattloom.plans import forecasting, training
from wattloom.plans.feature_table import feature_table, prepare_day_ahead
from wattloom.sources import readers, writers
from workload.fixtures import COEFS, INTERCEPT, Fixtures
from workload.q_models import FEATS, LAGS, _train_frame


@pytest.fixture(scope="module")
def frame(spark, sf):
    return _train_frame(Fixtures(spark, sf)).persist()


def test_boosted_trees_beat_the_lag_baseline(frame):
    model = training.fit_boosted_trees(frame, FEATS, "label_1", {"maxDepth": 3}, rounds=3)
    got = training.score_splits(model, frame, "label_1").where("split = 'test'").agg(ev.rmse()).first()[0]
    lag = frame.where("split = 'test'").select(F.col("label_1").alias("y_true"), F.col("lag7_total").alias("y_pred"))
    assert got < lag.agg(ev.rmse()).first()[0]


def test_search_is_repeatable_and_halves(frame):
    a = training.tune_boosted_trees(frame, LAGS, "label_1", n_trials=4, rounds=4)
    b = training.tune_boosted_trees(frame, LAGS, "label_1", n_trials=4, rounds=4, parallel=1)
    assert a[0] == b[0] and [t["rmse"] for t in a[1]] == [t["rmse"] for t in b[1]]
    assert sorted(t["rounds"] for t in a[1]) == [1, 1, 2, 4]
    last = [t for t in a[1] if t["rounds"] == 4]
    assert [t["params"] for t in last] == [a[0]] and not any("error" in t for t in a[1])


def test_failed_trials_leave_the_search(frame, monkeypatch):
    monkeypatch.setattr(training, "SPACE", {"maxDepth": [2, 99]})
    best, trials = training.tune_boosted_trees(frame, LAGS, "label_1", n_trials=6, rounds=1)
    assert best == {"maxDepth": 2} and any("error" in t for t in trials)
    monkeypatch.setattr(training, "SPACE", {"maxDepth": [99]})
    with pytest.raises(RuntimeError, match="every trial failed"):
        training.tune_boosted_trees(frame, LAGS, "label_1", n_trials=2, rounds=1)


def test_no_row_is_lost_in_scoring(frame):
    model, _, _ = training.fit_linear(frame, FEATS, "label_1")
    out = training.score_splits(model, frame, "label_1")
    assert out.count() == frame.count()
    missing = frame.where("lag14_total is null").count()
    assert out.where("y_pred is null").count() == missing > 0


def test_forecasting_job(spark, sf, tmp_path):
    raw = Fixtures(spark, sf)
    features = feature_table(raw.merged())
    day_ahead = prepare_day_ahead(features)
    day_ahead.data = day_ahead.data.cache()
    assert {"Acorn", "season", "holiday_category"} <= set(day_ahead.features)
    model, scored = forecasting.forecast(day_ahead, params={"maxDepth": 3}, rounds=3, early_stopping=False)
    _, again = forecasting.forecast(day_ahead, params={"maxDepth": 3}, rounds=3, early_stopping=False)
    rows, twice = ({(r.LCLid, r.day): r for r in x.collect()} for x in (scored, again))
    assert rows == twice and len(rows) == day_ahead.data.count()
    lag = forecasting.against_lag(scored, raw.meter(), F.col("total_kwh")).where("split = 'test'").collect()
    rmse = {r.model: r.rmse for r in lag}
    assert rmse["trees"] < rmse["lag"]
    model.save(str(tmp_path / "m"))
    back = forecasting.ForecastModel.load(spark, str(tmp_path / "m"))
    assert {(r.LCLid, r.day): r for r in back.score(day_ahead.data, "label_1").collect()} == rows
    test = day_ahead.data.where("split = 'test'")
    odd = test.withColumn("Acorn", F.lit("never seen")).withColumn("season", F.lit(None).cast("string")).withColumn("lag1_total", F.lit(None).cast("double"))
    got = back.score(odd, "label_1")
    assert got.count() == test.count() and got.where("y_pred is null").isEmpty()
    back.fills.pop("lag1_total")
    assert back.score(odd, "label_1").where("y_pred is not null").isEmpty()
    code = lambda c: F.col("__x")[back.features.index(c)].alias(c)
    coded = back.encoded(odd).select(code("Acorn"), code("season"), code("LCLid")).distinct().collect()
    assert {r.Acorn for r in coded} == {float(back.sizes["Acorn"])} and {r.season for r in coded} == {-1.0}
    assert {r.LCLid for r in coded} == {float(i) for i in range(back.sizes["LCLid"])}


def test_global_and_cluster_models(spark, frame):
    out = forecasting.per_cluster(frame, FEATS, "label_1", [0, 1, 2], params={"maxDepth": 2}, rounds=2)
    n = {(r.model): r["count"] for r in out.groupBy("model").count().collect()}
    assert n["global"] == frame.count() == sum(v for k, v in n.items() if k != "global")


def test_linear_contributions_add_up(frame):
    model, coefs, b = training.fit_linear(frame, FEATS, "label_1")
    pred = model.transform(frame).select("LCLid", "day", "prediction")
    total = drivers.contributions(frame, coefs, b).groupBy("LCLid", "day").agg(
        (F.first("base_value") + F.sum("contribution")).alias("p")
    )
    gap = pred.where(F.col("prediction").isNotNull() & ~F.isnan("prediction")).join(total, ["LCLid", "day"]).agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0]
    assert gap < 1e-6


def test_model_survives_a_round_trip(frame, tmp_path):
    model, _, _ = training.fit_linear(frame, LAGS, "label_1")
    writers.save_model(model, str(tmp_path / "m"))
    again = writers.load_model(str(tmp_path / "m"))
    assert again.stages[-1].coefficients == model.stages[-1].coefficients


def test_features_survive_a_round_trip(spark, sf, tmp_path):
    m = Fixtures(spark, sf).meter()
    writers.write_features(m, str(tmp_path / "f"))
    back = readers.scan_features(spark, str(tmp_path / "f"), ["LCLid", "day", "total_kwh"])
    assert back.exceptAll(m).isEmpty() and back.count() == m.count()


def test_archetypes_label_every_household(spark, sf):
    p = Fixtures(spark, sf).profiles_raw()
    labels, score = training.kmeans_load_shapes(p, k=2)
    assert labels.count() == p.select("LCLid").distinct().count() and -1 <= score <= 1


def test_recursive_forecast_steps_forward(spark, sf, frame):
    model, _, _ = training.fit_linear(frame, LAGS, "total_kwh")
    hist = Fixtures(spark, sf).meter()
    out = training.recursive_forecast(model, hist, 2)
    assert out.count() == 2 * hist.select("LCLid").distinct().count()
    last = hist.groupBy("LCLid").agg(F.max("day").alias("m"))
    gaps = out.join(last, "LCLid").where(F.datediff("day", "m") != F.col("step"))
    assert gaps.isEmpty()


def test_short_and_gappy_histories_come_back(spark):
    rows = [("short", d, float(d)) for d in range(1, 4)] + [("gap", d, None if d in (3, 14) else float(d)) for d in range(1, 21)]
    df = spark.createDataFrame(rows, "LCLid string, d int, total_kwh double").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    ring = {r.LCLid: r.recent for r in training.recent_values(df, 14, "total_kwh").collect()}
    assert ring["short"] == [None] * 11 + [1.0, 2.0, 3.0]
    assert ring["gap"] == [float(d) if d != 14 else None for d in range(7, 21)]
    lag1 = training.recursive_forecast(training.LinearScorer({"lag1_total": 1.0, "roll7_total_mean": 1.0}), df, 2).collect()
    got = {(r.LCLid, r.step): r.y_pred for r in lag1}
    assert got["short", 1] == 3.0 + 2.0 and got["short", 2] == 5.0 + (1 + 2 + 3 + 5) / 4
    assert got["gap", 1] == 20.0 + (15 + 16 + 17 + 18 + 19 + 20) / 6
    lag7 = training.recursive_forecast(training.LinearScorer({"lag7_total": 1.0}), df, 2).collect()
    assert {(r.LCLid, r.step): r.y_pred for r in lag7} == {("short", 1): None, ("short", 2): None, ("gap", 1): None, ("gap", 2): 15.0}


def test_donors_are_a_permutation(frame):
    df = frame.select("LCLid", "day", "lag1_total", "month").na.drop()
    got = training.shuffled_neighbour(df, ["LCLid", "day"], bins=7).collect()
    own, donor = [(r.LCLid, r.day) for r in got], [tuple(r["__donor"]) for r in got]
    assert sorted(own) == sorted(donor) and all(a != b for a, b in zip(own, donor, strict=True))


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().executedPlan().toString().count("Exchange SinglePartition")


def test_studies_need_no_exchange_per_feature(frame):
    model, _, _ = training.fit_linear(frame, FEATS, "label_1")
    one, all_of = (_exchanges(training.permutation_importance(model, frame, FEATS, "label_1", f)) for f in (FEATS[:1], FEATS))
    assert one == all_of
    one, all_of = (_exchanges(training.partial_dependence(model, frame, f)) for f in (FEATS[:1], FEATS[:6]))
    assert one == all_of
    p = training.permutation_importance(model, frame, FEATS, "label_1").collect()
    assert {r.feature for r in p} == set(FEATS) and max(r.rmse_rise for r in p) > 0


def test_a_null_takes_a_row_from_its_own_pairs_only(frame):
    df = frame.withColumns({"copy": F.col("lag1_total") * 2, "flat": F.lit(1.0), "holes": F.when(F.col("month") > 6, F.col("month"))})
    kept, pairs = training.prune_correlated(df, ["lag1_total", "copy", "month", "flat", "holes"])
    assert kept == ["lag1_total", "month", "flat"] and pairs.count() == 2
    few = training.pair_correlations(df, ["lag1_total", "copy", "month", "holes"], at_once=2)
    n = {(r.a, r.b): r.rows for r in few.collect()}
    assert len(n) == 6 and n["month", "holes"] < n["lag1_total", "month"]


def test_driver_report_has_one_row(spark, sf):
    df = splits.split_by_date_position(Fixtures(spark, sf).contribution_input())
    groups = columns.feature_groups(list(COEFS), "dated_study")
    rows = training.driver_report(df, list(COEFS), "total_kwh", groups).collect()
    assert len(rows) == 1 and rows[0].total_features == len(COEFS) and INTERCEPT == 2.0
