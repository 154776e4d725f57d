"""What must not grow with the tables: repeated passes, rows a task sorts, work of the studies."""

import os
import re
import time

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from wattloom.operators import drivers
from wattloom import session
from wattloom.plans import forecasting, training
from wattloom.plans.feature_table import Prepared
from wattloom.sources import writers
from workload.fixtures import Fixtures


@pytest.fixture(scope="module")
def days(spark):
    """Eight households over 200 days, split by day, with a count of the rows made."""
    made = spark.sparkContext.accumulator(0)

    def counted(rows):
        for i in rows:
            made.add(1)
            h, d = divmod(i, 200)
            yield f"H{h}", d, float((i * 7919) % 101), float(d % 7), float((i * 7919) % 101 + d % 7), h % 2

    shape = "LCLid string, d int, x1 double, x2 double, y double, cluster int"
    df = spark.createDataFrame(spark.sparkContext.range(1600, numSlices=2).mapPartitions(counted), shape)
    split = F.when(F.col("d") < 140, "train").when(F.col("d") < 170, "val").otherwise("test").alias("split")
    return df.select("LCLid", F.date_add(F.lit("2013-01-01").cast("date"), "d").alias("day"), "x1", "x2", "y", "cluster", split), made


def passes(made, work) -> float:
    before = made.value
    work()
    return (made.value - before) / 1600


def test_cluster_models_read_the_input_once(days):
    df, made = days
    fit = {"params": {"maxDepth": 2}, "rounds": 1}
    assert passes(made, lambda: forecasting.per_cluster(df, ["x1", "x2"], "y", [0, 1], **fit).collect()) == 1


def test_driver_report_reads_the_input_once(days):
    df, made = days
    assert passes(made, lambda: training.driver_report(df, ["x1", "x2"], "y", {"a": ["x1"], "b": ["x2"]}).collect()) == 1


@pytest.mark.parametrize("stopping", [True, False])
def test_boosting_reads_the_input_twice_at_most(days, stopping):
    df, made = days
    assert passes(made, lambda: training.fit_boosted_trees(df, ["x1", "x2"], "y", {"maxDepth": 2}, 2, early_stopping=stopping)) <= 2


def plans_of_fits(monkeypatch) -> list[str]:
    seen, plain = [], GBTRegressor.fit

    def fit(self, rows, *more):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return plain(self, rows, *more)

    monkeypatch.setattr(GBTRegressor, "fit", fit)
    return seen


def test_trees_read_vectors_that_are_made_already(days, monkeypatch):
    df, _ = days
    seen = plans_of_fits(monkeypatch)
    forecasting.fit_forecaster(df, ["x1", "x2"], "y", {"maxDepth": 2}, 1)
    training.tune_boosted_trees(df, ["x1", "x2"], "y", n_trials=2, rounds=1)
    assert len(seen) >= 4 and not any("UDF" in p or "transform(" in p for p in seen)


def test_large_folds_are_searched_one_by_one(days, monkeypatch):
    df, _ = days
    asked = []

    class Pool(training.ThreadPoolExecutor):
        def __init__(self, n):
            asked.append(n)
            super().__init__(n)

    monkeypatch.setattr(training, "ThreadPoolExecutor", Pool)
    few = training.tune_boosted_trees(df, ["x1", "x2"], "y", n_trials=2, rounds=1)
    monkeypatch.setattr(training, "ROWS_AT_ONCE", 100)
    one = training.tune_boosted_trees(df, ["x1", "x2"], "y", n_trials=2, rounds=1)
    assert asked == [4, 1] and few == one


def test_a_trial_reads_the_rows_of_its_fold_only(days, spark, monkeypatch):
    df, _ = days
    seen, kept = plans_of_fits(monkeypatch), spark.sparkContext._jsc.getPersistentRDDs().size()
    training.tune_boosted_trees(df, ["x1", "x2"], "y", n_trials=2, rounds=1)
    assert seen and all(re.match(r"InMemoryRelation \[label#\d+, features#\d+\], StorageLevel\(disk, ", p) for p in seen)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_test_rows_keep_no_trial_waiting(days, monkeypatch):
    df, _ = days
    asked = []

    class Pool(training.ThreadPoolExecutor):
        def __init__(self, n):
            asked.append(n)
            super().__init__(n)

    monkeypatch.setattr(training, "ThreadPoolExecutor", Pool)
    # a single fold of 1360 known rows: about half of them train, and only these stay in memory
    monkeypatch.setattr(training, "ROWS_AT_ONCE", 1360)
    training.tune_boosted_trees(df, ["x1", "x2"], "y", n_trials=2, rounds=1, folds=1)
    assert asked == [2]


def test_a_forecast_leaves_little_on_disk(spark, tmp_path, monkeypatch):
    """Training rows of many inputs: compressed columns and no checkpoint, and no copy in shuffle files."""
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    split = F.when(F.col("id") % 500 < 400, "train").when(F.col("id") % 500 < 450, "val").otherwise("test")
    day = F.date_add(F.lit("2013-01-01").cast("date"), (F.col("id") % 500).cast("int"))
    inputs = {f"x{i}": F.hash("id", F.lit(i)) % 101 / 7.0 for i in range(40)}
    df = spark.range(20000, numPartitions=3).select(F.concat(F.lit("H"), F.floor(F.col("id") / 500)).alias("LCLid"), day.alias("day"), split.alias("split"), *[x.alias(c) for c, x in inputs.items()])
    prepared = Prepared(df.withColumn("y", F.abs("x1") + F.abs("x2")), list(inputs), "y", {})
    seen = plans_of_fits(monkeypatch)
    _, scored = forecasting.forecast(prepared, params={"maxDepth": 2}, rounds=1)
    assert scored.where("y_pred is not null").count() == 20000
    assert len(seen) == 2 and all("] parquet" in p for p in seen)
    stores = [x for x in os.listdir(tmp_path) if x.startswith("vectors-")]
    used = sum(os.path.getsize(tmp_path / stores[0] / f) for f in os.listdir(tmp_path / stores[0]))
    assert len(stores) == 1 and used < 0.5 * 18000 * 42 * 8


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def shuffles():
        top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in top for _, _, names in os.walk(d) for f in names if re.match(r"shuffle_\d+_.*\.data", f)}

    before = shuffles()
    out = session.stored(spark.range(5000).groupBy((F.col("id") % 997).alias("k")).count(), "t")
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 997
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_pair_correlations_is_one_short_aggregate(spark):
    rows = [(1.0, 2.0, None, None), (2.0, 4.0, 1.0, None), (3.0, 6.5, 1.0, None), (None, 1.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, c double")
    out = training.pair_correlations(df, ["a", "b", "flat", "c"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("covar_pop") <= 2
    got = {(r.a, r.b): (r.rows, r.r) for r in out.collect()}
    assert got["a", "b"][0] == 3 and got["a", "b"][1] == pytest.approx(0.9979486)
    assert got["a", "flat"] == (2, None) and got["a", "c"] == (0, None) and len(got) == 6
    none = training.pair_correlations(df.where("b > 100"), ["a", "b"]).collect()
    assert [(r.rows, r.r) for r in none] == [(0, None)]


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_local_insights_orders_only_the_households_it_picks(spark, k):
    keys = [(h, d) for h in (None, "A", "B", "C", "D") for d in (3, 1, 2, None)][: 20 if k < 7 else 5]
    rows = [(h, d, f, 1.0, float(i), 0.0) for h, d in keys + keys[:3] for i, f in enumerate("xyz")]
    contrib = spark.createDataFrame(rows, "LCLid string, day int, feature string, feature_value double, contribution double, base_value double")
    out = drivers.local_insights(contrib, k=k, top=1)
    assert "xxhash64(LCLid" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and not re.search(r"xxhash64\(LCLid#\d+, day", plan)
    order = sorted(keys, key=lambda x: (x[0] or "", x[1] or 0))
    want = {order[i * (len(order) - 1) // max(k - 1, 1)] for i in range(k)}
    assert {(r.LCLid, r.day) for r in out.collect()} == {x for x in want if None not in x}


def test_a_month_is_written_by_as_many_tasks_as_it_needs(spark, tmp_path):
    days = F.date_add(F.lit("2013-01-01").cast("date"), (F.col("id") % 28).cast("int")).alias("day")
    df = spark.range(40000, numPartitions=8).select(F.concat(F.lit("H"), F.col("id") % 997).alias("LCLid"), days, F.rand(1).alias("v"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        writers.write_features(df, str(tmp_path / "f"))
    finally:
        spark.conf.set(key, before)
    files = [x for x in os.listdir(tmp_path / "f" / "month_start=2013-01-01") if x.endswith(".parquet")]
    assert len(files) > 4
    assert spark.read.parquet(str(tmp_path / "f")).drop("month_start").exceptAll(df).isEmpty()


def test_panel_windows_sort_short_rows(spark, sf):
    plan = Fixtures(spark, sf).lagged()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter, (day") < plan.index("lag(total_kwh")
