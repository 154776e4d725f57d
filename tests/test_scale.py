"""Exactness under skew, and the shape of the plans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import analytics as an
from wattloom.operators import clean, clusters, encode, panel
from wattloom.operators.quantiles import five_number, pct_rank_true, quantiles, rank_values
from wattloom.plans import feature_table as ft
from workload.fixtures import Fixtures


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows and one value a third of that key."""
    r = random.Random(7)
    rows = []
    for i in range(6000):
        k = None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{r.randrange(20)}"
        v = None if i % 97 == 0 else 5.0 if i % 9 == 0 else round(r.gauss(10, 5), 3)
        rows.append((i, k, v))
    return spark.createDataFrame(rows, "i int, k string, v double")


def test_quantiles_match_numpy_under_skew(spark, skewed):
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    rows = [(r.k, r.v) for r in skewed.collect() if r.v is not None]
    got = {r.k: r for r in quantiles(skewed, "v", probs, ["k"]).collect()}
    assert set(got) == {k for k, _ in rows}
    for k, r in got.items():
        vals = [v for x, v in rows if x == k]
        assert r.n == len(vals)
        assert np.allclose(r.q, np.quantile(vals, probs))
    whole = quantiles(skewed, "v", probs).first()
    assert np.allclose(whole.q, np.quantile([v for _, v in rows], probs))


@pytest.mark.parametrize("bins", [2, 3, 64, 500])
def test_bins_do_not_change_the_result(skewed, bins):
    a = quantiles(skewed, "v", [0.1, 0.5], bins=bins).first()
    b = quantiles(skewed, "v", [0.1, 0.5]).first()
    assert a.q == b.q and a.n == b.n
    ranks = rank_values(skewed.where("v is not null"), ["v"], bins=bins).orderBy("v").collect()
    assert [r.code for r in ranks] == list(range(len(ranks)))
    assert all(x.below + x.c == y.below for x, y in zip(ranks, ranks[1:]))


def test_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", None)], "k string, v double")
    got = {r.k: r.median for r in five_number(df, "v", ["k"]).collect()}
    assert got == {"a": 1.0, "b": 1.5}


def test_pct_rank_matches_average_ties(skewed):
    df = skewed.where("v is not null")
    got = {r.i: r.pct_true_rank for r in pct_rank_true(df, "v").collect()}
    rows = [(r.i, r.v) for r in df.collect()]
    vals = np.array([v for _, v in rows])
    for i, v in rows[:300]:
        want = ((vals < v).sum() + ((vals == v).sum() + 1) / 2) / len(vals) * 100
        assert got[i] == pytest.approx(want)


def test_codes_have_one_type_and_number_sorted_values(spark, skewed):
    coded = encode.encode_labels(skewed, "k", "code").select("k", "code")
    assert coded.schema["code"].dataType.simpleString() == "int"
    got = {r.k: r.code for r in coded.where("k is not null").distinct().collect()}
    assert got == {k: n for n, k in enumerate(sorted(got))}


def test_top_per_key_is_pruned_before_the_exchange(skewed):
    plan = planned(an.top_n_per_key(skewed.where("v is not null"), ["k"], "v", 3, ["i"]))
    assert plan.count("WindowGroupLimit") == 2


def test_panel_has_one_exchange_by_household(spark, sf):
    plan = executed(panel.panel_safe(Fixtures(spark, sf).meter()))
    final = plan.split("Initial Plan")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(LCLid", final)) == 1


def test_feature_table_plan(spark, sf):
    plan = executed(Fixtures(spark, sf).feature_table()).split("Initial Plan")[0]
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # the panel once, for the household join and all windows, and the household table
    assert len(re.findall(r"Exchange hashpartitioning\(LCLid", plan)) <= 2
    # line items: once for the panel; their days for the first day and, with weather, for the quartiles
    assert len(re.findall(r"FileScan parquet \[l_", plan)) <= 3


def test_counting_for_quantiles_runs_once(spark, sf):
    plan = executed(quantiles(Fixtures(spark, sf).meter(), "total_kwh", [0.5]))
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


def test_scan_reads_only_what_is_asked(spark, sf):
    df = Fixtures(spark, sf).table("lineitem").where("l_quantity > 10").select("l_suppkey")
    plan = planned(df)
    assert "GreaterThan(l_quantity,10.0)" in plan
    assert re.search(r"ReadSchema: struct<l_suppkey:bigint,l_quantity:double>", plan)


def test_packing_has_no_sort(spark, sf):
    plan = executed(clean.pack_readings(Fixtures(spark, sf).readings())).split("Initial Plan")[0]
    assert "Sort" not in plan and "ObjectHashAggregate" not in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_first_day_rows_needs_no_window(spark):
    rows = [("A", "2013-01-02", 1), ("A", "2013-01-01", 2), ("B", "2013-01-01", 3)]
    df = spark.createDataFrame(rows, "LCLid string, day string, cluster int").withColumn("day", F.to_date("day"))
    out = clusters.first_day_rows(df, "cluster")
    assert "Window" not in planned(out) and "SortAggregate" not in planned(out)
    assert {r.LCLid: r.cluster for r in out.collect()} == {"A": 2, "B": 3}
