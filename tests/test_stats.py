"""Statistics against numpy and pandas, small groups and large ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from queuescope.operators import errors as E
from queuescope.operators import stats as S
from queuescope.operators.scan import ScanPlan
from queuescope.plans.estimate import current_estimate_errors


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(
        {
            "k": rng.choice(["a", "b", "c"], 2000, p=[0.8, 0.15, 0.05]),
            "v": np.round(rng.lognormal(1, 1, 2000), 2),
        }
    )
    frame.loc[:600, "v"] = 3.0
    return frame


@pytest.fixture(scope="module")
def table(spark, values):
    return spark.createDataFrame(values)


@pytest.mark.parametrize("rows", ["1000000", "10"])
def test_quantiles(spark, table, values, rows):
    spark.conf.set("spark.queuescope.groupRows", rows)
    spark.conf.set("spark.queuescope.sliceRows", "90")
    try:
        probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
        got = {r.k: (r.n, r.quantiles) for r in S.quantiles(table, ["k"], "v", probs).collect()}
        for k, v in values.groupby("k")["v"]:
            assert got[k][0] == len(v)
            assert got[k][1] == pytest.approx(list(np.quantile(v, probs)))
        (one,) = S.quantiles(table, [], "v", probs).collect()
        assert one.quantiles == pytest.approx(list(np.quantile(values.v, probs)))
        (d,) = S.describe(table, "v").collect()
        wanted = values.v.describe()
        assert list(d) == pytest.approx(list(wanted))
    finally:
        spark.conf.unset("spark.queuescope.groupRows")
        spark.conf.unset("spark.queuescope.sliceRows")


@pytest.mark.parametrize("bins", [10, 30, 50])
def test_histogram(table, values, bins):
    counts, edges = np.histogram(values.v, bins)
    got = S.histogram(table, "v", bins).orderBy("bin").collect()
    assert [r.n for r in got] == list(counts)
    assert [r.lower for r in got] == pytest.approx(list(edges[:-1]))


def test_histogram_of_one_value_and_of_none(spark):
    same = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    counts, edges = np.histogram([2.0, 2.0], 4)
    got = S.histogram(same, "v", 4).orderBy("bin").collect()
    assert [r.n for r in got] == list(counts)
    assert [r.lower for r in got] == pytest.approx(list(edges[:-1]))
    assert [r.n for r in S.histogram(same.filter("v > 9"), "v", 3).collect()] == [0, 0, 0]


def test_box_summary(table, values):
    got = {r.k: r for r in S.box_summary(table, ["k"], "v").collect()}
    for k, v in values.groupby("k")["v"]:
        low, mid, high = np.quantile(v, S.QUARTILES)
        reach = 1.5 * (high - low)
        inside = v[(v >= low - reach) & (v <= high + reach)]
        r = got[k]
        assert (r.q25, r.q50, r.q75) == pytest.approx((low, mid, high))
        assert (r.whisker_low, r.whisker_high) == (inside.min(), inside.max())
        assert r.outliers == len(v) - len(inside)


def test_top_keys_break_ties_by_key(spark):
    df = spark.createDataFrame([(x,) for x in "bbaaccd"], "k string")
    assert [r.k for r in S.top_keys(df, "k", 2).collect()] == ["a", "b"]
    assert sorted(r.k for r in S.topk_subset(df, "k", 2).collect()) == list("aabb")
    assert [tuple(r) for r in S.value_counts(df, "k").collect()][-1] == ("d", 1)


def test_correlation_of_a_single_row_is_unknown(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "s int, a double, b double")
    (r,) = S.correlation(df, [("a", "b")], ["s"]).collect()
    assert r.corr_a_b is None


EVENTS = "session_id int, tid string, fqdn string, gpu_est_total double, e2etime double, compute string"


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (0, "a", None, 2.0, None, None), (0, "a", "f", None, 1.0, "GPU"),
        (0, "a", None, 3.0, None, None),
        (0, "b", "g", 1.0, 4.0, "CPU"),
        (0, "c", "f", None, 4.0, "GPU"),
        (1, "a", "f", 1.0, 0.0, "GPU"),
        (1, None, "f", 1.0, 1.0, "GPU"),
        (1, "d", None, 1.0, 1.0, "GPU"),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_estimate_errors(log):
    got = {(r.session_id, r.tid): r for r in current_estimate_errors(log).collect()}
    assert set(got) == {(0, "a"), (1, "a")}
    r = got[0, "a"]
    assert (r.absolute_error, r.squared_error, r.percentage_relative_error) == (2.0, 4.0, -200.0)
    assert got[1, "a"].percentage_relative_error is None


def test_error_tables(log):
    errors = current_estimate_errors(log)
    (s,) = E.error_summary(errors, "e2etime", "gpu_est_total").collect()
    assert (s.n, s.mse, s.mae, s.mpre) == (2, 2.5, 1.5, -200.0)
    assert s.std_error == pytest.approx(np.std([2.0, 1.0], ddof=1))
    other = errors.withColumn("percentage_relative_error", F.lit(-50.0)).union(
        errors.withColumn("fqdn", F.lit("only-here"))
    )
    (c,) = E.estimator_comparison(errors, other).collect()
    assert tuple(c) == ("f", -200.0, -50.0, 150.0)
    assert [r.fqdn for r in E.common_keys(errors, other, "fqdn").collect()] == ["f"]


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "s int, only_a string")
    b = spark.createDataFrame([(2, 5)], "s int, only_b int")
    got = sorted(map(tuple, S.union_sessions(a, b).collect()))
    assert got == [(1, "x", None), (2, None, 5)]


def test_session_selection(spark):
    df = spark.range(6).withColumnRenamed("id", "session_id")
    assert [r[0] for r in S.without_sessions(df, [4], after=2).orderBy("session_id").collect()] == [3, 5]
    assert S.without_sessions(df, [4]).count() == 5


def test_plan_argument_is_used(table):
    by_rank = S.quantiles(table, ["k"], "v", [0.5], ScanPlan(mode="range", slices=4))
    plain = S.quantiles(table, ["k"], "v", [0.5], ScanPlan())
    assert sorted(map(str, by_rank.collect())) == sorted(map(str, plain.collect()))
