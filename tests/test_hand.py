"""Small hand-made tables for the edges of each rule."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.functions import calendar as cal
from wattloom.functions import profile as prof
from wattloom.functions import weather as wx
from wattloom.operators import analytics as an
from wattloom.operators import clean, clusters, columns, encode, panel, splits
from wattloom.operators import evaluate as ev

D0 = dt.date(2013, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def profiles(spark, rows):
    data = [(f"M{i}", D0, [None if v is None else float(v) for v in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "LCLid string, day date, hh array<double>")


def panel_of(spark, values, name="A"):
    return spark.createDataFrame([(name, day(i), float(v)) for i, v in enumerate(values)], "LCLid string, day date, total_kwh double")


def test_gaps_are_filled_like_numpy_interp(spark):
    base = [float((i * 7) % 11) for i in range(48)]
    holes = [range(0, 5), range(20, 24), range(40, 48), [3, 9, 30], range(0, 47)]
    rows = [[None if i in h else v for i, v in enumerate(base)] for h in holes] + [[None] * 48]
    got = {r.LCLid: r.hh for r in clean.interpolate_profile(profiles(spark, rows)).collect()}
    for k, r in enumerate(rows[:-1]):
        x = [i for i, v in enumerate(r) if v is not None]
        want = np.interp(range(48), x, [r[i] for i in x])
        assert np.allclose(got[f"M{k}"], want)
    assert got["M5"] == [None] * 48


def test_nine_gaps_pass_and_ten_do_not(spark):
    rows = [[None] * n + [1.0] * (48 - n) for n in (9, 10)]
    assert [r.LCLid for r in clean.drop_sparse_days(profiles(spark, rows)).collect()] == ["M0"]


def test_profile_ties_zero_day_and_spike(spark):
    tie = [1.0] * 48
    tie[10] = tie[30] = 5.0
    spike = [0.0] * 47 + [4.0]
    df = prof.consumption_features(profiles(spark, [tie, [0.0] * 48, spike]))
    tied, zero, one = sorted(df.collect(), key=lambda r: r.LCLid)
    assert tied.peak_hour == 10
    assert zero.peak_to_mean_ratio is None and zero.load_factor is None and zero.usage_concentration is None
    assert one.usage_concentration == 1.0 and one.peak_hour == 47
    blocks = tied.morning_kwh + tied.afternoon_kwh + tied.evening_kwh + tied.night_kwh
    assert blocks == pytest.approx(tied.total_kwh)
    assert tied.std_kwh == pytest.approx(np.std(tie))
    assert tied.base_load == pytest.approx(np.percentile(tie, 10))


def test_gini_bounds(spark):
    flat, spike = prof.gini(profiles(spark, [[2.0] * 48, [0.0] * 47 + [4.0]])).orderBy("LCLid").collect()
    assert flat.gini == pytest.approx(0) and spike.gini == pytest.approx(47 / 48)


def test_missing_slot_gives_null_total(spark):
    row = prof.profile_totals(profiles(spark, [[None] + [1.0] * 47])).first()
    assert row.total_kwh is None and row.peak_kwh == 1.0


def test_pack_and_unpack(spark):
    data = [("A", dt.datetime(2013, 1, 1, 0, 10), 1.0), ("A", dt.datetime(2013, 1, 1, 0, 29), 2.0), ("A", dt.datetime(2013, 1, 1, 23, 30), 4.0)]
    df = spark.createDataFrame(data, "LCLid string, ts timestamp_ntz, kwh double")
    hh = clean.pack_readings(df).first().hh
    assert len(hh) == 48 and hh[0] == 3.0 and hh[47] == 4.0 and hh[1] is None
    last = clean.unpack_profile(clean.pack_readings(df, fill=0.0)).where("slot = 47").first()
    assert last.label == "23:30" and last.kwh == 4.0


def test_lags_count_rows_not_days(spark):
    rows = [("A", day(0), 1.0), ("A", day(5), 2.0), ("A", day(6), 4.0), ("B", day(0), 9.0)]
    df = spark.createDataFrame(rows, "LCLid string, day date, total_kwh double")
    got = panel.delta_safe(panel.rolling_mean_safe(panel.lags_safe(df))).orderBy("LCLid", "day").collect()
    assert [r.lag1_total for r in got] == [None, 1.0, 2.0, None]
    assert got[2].roll7_total_mean == 1.5 and got[2].delta1_total == 1.0 and got[0].pct_change1_total == 0.0
    plain = panel.rolling_plain(df).orderBy("LCLid", "day").collect()
    assert plain[0].roll7_total_std is None and plain[1].roll7_total_mean == 1.5


@pytest.mark.parametrize("n", [1, 2, 7, 8, 29, 30])
def test_short_households(spark, n):
    df = panel_of(spark, range(n))
    assert panel.label_week_ahead(df).count() == max(n - 7, 0)
    assert clean.keep_active_households(df).count() == (n if n >= 30 else 0)


def test_safe_features_do_not_see_the_future(spark):
    a, b = panel_of(spark, [1, 2, 3, 4, 5]), panel_of(spark, [1, 2, 3, 40, 50])
    cols = ["lag1_total", "roll7_total_mean", "delta1_total", "pct_change1_total"]
    early = [panel.panel_safe(x).where(F.col("day") <= day(3)).select(*cols).collect() for x in (a, b)]
    assert early[0] == early[1]


def test_sequences_skip_nulls(spark):
    rows = [("A", day(i), float(i), None if i == 3 else 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "LCLid string, day date, total_kwh double, x double")
    got = panel.sequences(df, ["total_kwh", "x"], "total_kwh", seq_len=2).orderBy("day").collect()
    assert [r.y for r in got] == [2.0, 3.0, 6.0, 7.0]
    assert got[0].X == [[0.0, 1.0], [1.0, 1.0]]


def test_weather_edges(spark):
    rows = [(day(0), None), (day(1), 10.0), (day(2), None), (day(4), 40.0), (day(5), None)]
    df = spark.createDataFrame(rows, "day date, humidity double")
    got = clean.interpolate_weather_time(df, ["humidity"]).orderBy("day").collect()
    assert [r.humidity for r in got] == [10.0, 10.0, 20.0, 40.0, 40.0]


def test_constant_temperature_has_no_correlation(spark):
    df = panel_of(spark, [1, 2, 3]).withColumns({"temperatureMax": F.lit(5.0), "temperatureMin": F.lit(1.0)})
    row = wx.temp_sensitivity(wx.temp_features(df)).first()
    assert row.temp_sensitivity is None and row.heating_degree_days == 12.0
    assert wx.temp_impact(panel_of(spark, [1]).withColumn("temperatureMax", F.lit(5.0))).first().temp_impact == 0.0


def test_null_temperature_stays_null(spark):
    nothing = F.lit(None).cast("double")
    df = panel_of(spark, [1]).withColumns({"temperatureMax": nothing, "temperatureMin": nothing})
    row = wx.temp_extremes(wx.temp_features(df)).first()
    assert row.heating_degree_days is None and row.is_very_cold == 0


def test_two_holidays_on_one_day_do_not_copy_readings(spark):
    hol = spark.createDataFrame([(D0, "Royal Wedding"), (D0, "Christmas Day")], "`Bank holidays` date, Type string")
    out = clean.fill_holiday_default(clean.join_holiday(panel_of(spark, [1, 2]), clean.map_holiday_category(hol)))
    got = out.orderBy("day").collect()
    assert [r.holiday_category for r in got] == ["Christmas", "Regular Day"]


def test_calendar(spark):
    row = cal.calendar_basic(panel_of(spark, [1])).first()  # a Tuesday
    assert (row.dayofweek, row.is_weekend, row.is_weekday, row.month, row.day_of_year) == (1, 0, 1, 1, 1)


def predictions(spark, pairs):
    rows = [("A", day(i), float(y), float(p)) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "LCLid string, day date, y_true double, y_pred double")


def test_metric_edges(spark):
    df = predictions(spark, [(0, 1), (0.05, 0.1), (0, 0), (2, 1)])
    m = ev.forecast_metrics(df).first()
    assert m.mape == pytest.approx((1 + 0.5) / 2 * 100)
    one = df.agg(ev.mape(0.1).alias("clip"), ev.smape().alias("s")).first()
    assert one.clip == pytest.approx(50)
    assert one.s == pytest.approx((2 + 0.05 / 0.075 + 1 / 1.5) / 3 * 100)
    flat = ev.forecast_metrics(predictions(spark, [(3, 1), (3, 2)])).first()
    assert flat.r2 is None and flat.bias == -1.5


def clustered(spark, **labels):
    rows = [(k, day(i), c) for k, cs in labels.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "LCLid string, day date, cluster int")


def test_switching_and_stability_edges(spark):
    df = clustered(spark, one=[1, 1, 1], alt=[0, 1, 0, 1], single=[2])
    sw = {r.LCLid: r for r in clusters.cluster_switching(df).collect()}
    assert set(sw) == {"one", "alt"} and sw["one"].switch_rate == 0 and sw["alt"].switch_rate == 1
    first = {r.LCLid: r for r in clusters.cluster_switching(df, count_first=True).collect()}
    assert first["one"].switch_rate == 0.5 and first["alt"].switch_rate == pytest.approx(4 / 3)
    st = {r.LCLid: r for r in clusters.cluster_stability(df).collect()}
    assert st["one"].stability_score == 1 and st["alt"].stability_score == pytest.approx(0)
    assert st["alt"].dominant_cluster == 0 and st["alt"].entropy == pytest.approx(1)


def test_t_distribution_tail(spark):
    # published two-sided values: t=2.228 at 10 and 12.706 at 1 degrees of freedom are 0.05
    df = spark.createDataFrame([(2.228139, 10.0), (12.706205, 1.0), (1.959964, 1e9), (0.0, 5.0)], "t double, dof double")
    got = [r.p for r in df.select(clusters.t_two_sided_p(F.col("t"), F.col("dof")).alias("p")).collect()]
    assert got == pytest.approx([0.05, 0.05, 0.05, 1.0], abs=1e-5)


def test_split_cutoffs(spark):
    got = splits.split_by_date(panel_of(spark, range(200)), 30, 90).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 80, "val": 30, "test": 90}
    own = splits.split_per_household(panel_of(spark, range(200))).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in own} == {"train": 51, "val": 60, "test": 89}
    assert splits.split_per_household(panel_of(spark, range(149))).count() == 0


def test_folds_keep_the_gap(spark):
    df = splits.rolling_origin_folds(panel_of(spark, range(60)))
    for f in range(1, 6):
        part = df.where(F.col("fold") == f)
        last = part.where("role = 'train'").agg(F.max("day")).first()[0]
        start = part.where("role = 'test'").agg(F.min("day")).first()[0]
        assert last is None or (start - last).days == 8


def test_unseen_value_raises_or_gets_its_own_code(spark):
    train = spark.createDataFrame([("a",), ("c",)], "v string")
    other = spark.createDataFrame([("a",), ("z",)], "v string")
    kept = encode.fit_apply_encoder(train, other, "v", "code", unseen="keep").orderBy("v").collect()
    assert [r.code for r in kept] == [0, 2]
    with pytest.raises(Exception, match="unseen value"):
        encode.fit_apply_encoder(train, other, "v", "code").collect()


def test_column_rules():
    cols = ["LCLid", "day", "total_kwh", "hh_0", "hh_avg_consumption", "peak_kwh", "peak_hour", "base_load_ratio", "lag1_total", "month"]
    assert columns.leaking_columns(cols) == ["total_kwh", "hh_0", "peak_kwh", "base_load_ratio"]
    assert columns.study_columns(cols) == ["hh_0", "hh_avg_consumption", "peak_hour", "month"]
    groups = columns.feature_groups(["month", "lag1_total", "lag1_weekend_heating", "x"])
    assert groups["lags"] == ["lag1_total", "lag1_weekend_heating"] and groups["other"] == ["x"]


def test_crosstab_rows_sum_to_100(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x")], "g string, t string")
    got = an.crosstab_row_pct(df, "g", "t").groupBy("g").agg(F.sum("pct").alias("p")).collect()
    assert all(math.isclose(r.p, 100) for r in got)


def test_inf_and_nan_become_null(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.0,)], "v double")
    assert sorted((r.v is None) for r in clean.inf_to_null(df, ["v"]).collect()) == [False, True, True]


def test_bad_text_becomes_null(spark):
    df = spark.createDataFrame([("1.5",), ("Null",), ("nan",)], "v string")
    assert [r.v for r in encode.cast_numeric_coerce(df, ["v"]).collect()] == [1.5, None, None]


def test_scaling_is_undone(spark):
    df = panel_of(spark, [1, 2, 3, 10])
    z = encode.scale_standard(df, ["total_kwh"], F.col("day") < day(3))
    assert z.agg(F.stddev_pop(F.when(F.col("day") < day(3), F.col("total_kwh_z")))).first()[0] == pytest.approx(1)
    back = encode.unscale_standard(z, "total_kwh_z", df.where(F.col("day") < day(3)), "total_kwh", "again")
    assert back.where(F.abs(F.col("again") - F.col("total_kwh")) > 1e-9).isEmpty()
    flat = encode.scale_standard(panel_of(spark, [4, 4]), ["total_kwh"]).select("total_kwh_z").collect()
    assert [r[0] for r in flat] == [0.0, 0.0]


def test_samples_do_not_depend_on_partitioning(spark):
    df = panel_of(spark, range(300))
    a = splits.sample_rows(df.repartition(7), 20).select("day").collect()
    b = splits.sample_rows(df.coalesce(1), 20).select("day").collect()
    assert sorted(a) == sorted(b) and len(a) == 20


def test_building_a_query_starts_no_job(spark, sf):
    from wattloom.operators import analytics, panel, splits
    from wattloom.plans.feature_table import feature_table, prepare_day_ahead
    from workload.fixtures import Fixtures

    fx = Fixtures(spark, sf)
    [fx.table(t) for t in ("lineitem", "supplier", "nation", "region", "orders")]  # footers are read once
    sc = spark.sparkContext
    sc.setJobGroup("building", "no job")
    try:
        m = fx.merged()
        frames = [
            m,
            prepare_day_ahead(feature_table(m)).data,
            clean.semi_join_ids(m, fx.household()),
            clean.cleaning_report(fx.profiles_raw(), fx.household(), fx.weather(), fx.holiday()),
            analytics.high_usage_households(m),
            panel.acorn_relatives(m),
            splits.select_scope(m, fx.household()),
            fx.slots(),
        ]
        [f.schema for f in frames]
        assert not sc.statusTracker().getJobIdsForGroup("building")
    finally:
        sc.setJobGroup("tests", "")


def test_doubled_weather_copies_no_readings(spark):
    days = spark.range(6).select(F.lit("a").alias("LCLid"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    weather = days.select("day", F.lit(1.5).alias("windSpeed"), F.lit(None).cast("double").alias("humidity"))
    out = clean.join_weather(days, weather.unionByName(weather).unionByName(weather.withColumn("windSpeed", F.lit(9.0))))
    assert out.count() == 6 and {r.windSpeed for r in out.collect()} == {1.5}


def test_one_value_in_most_rows_is_spread_over_the_tasks(spark):
    from wattloom.operators.quantiles import pct_rank_true

    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, 7.0).when(F.col("id") % 100 > 0, F.col("id").cast("double")).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = pct_rank_true(rows, "v").withColumn("task", F.spark_partition_id()).cache()
        assert got.count() == 20_000
        most = max(r["count"] for r in got.groupBy("task").count().collect())
        assert most < 0.3 * 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    known = sorted(r.v for r in rows.collect() if r.v is not None)
    rank = {v: (known.index(v) + (known.count(v) + 1) / 2) / len(known) * 100 for v in set(known[:50] + known[-50:] + [7.0])}
    for r in got.where("v is not null").dropDuplicates(["v"]).collect():
        if r.v in rank:
            assert abs(r.pct_true_rank - rank[r.v]) < 1e-9
    assert got.where("v is null and pct_true_rank is not null").isEmpty()
    got.unpersist()


def test_own_columns_of_the_day_do_not_leak():
    from wattloom.operators.columns import leaking_columns

    own = ["gini", "day_night_hours", "calculated_variability", "household_vs_acorn", "zscore_global", "zscore_personal", "total_kwh", "hh_3"]
    assert leaking_columns([*own, "lag1_total", "acorn_variability", "month"]) == own
