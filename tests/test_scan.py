"""Ordered scans against loops, in each of the three ways."""

import random

import pytest
from pyspark.sql import functions as F

from queuescope.operators.asof import asof_lookup, last_per_key
from queuescope.operators.scan import Lag, LastKnown, Limits, Replay, RunningSum, ScanPlan, _carry, position
from queuescope.operators import scan
from queuescope.registry import adapter
from queuescope.registry.adapter import measured
from queuescope.session import cut_lineage

DATA = "/root/testdata/sf0.001"

WAYS = ["whole", "time", "range"]


def plan_for(spark, way, key="k", hot=("hot", None)):
    """A plan in which the keys ``hot`` have time slices, each from its own origin."""
    if way == "whole":
        return ScanPlan()
    slices = [(k, 3 * i, 12 + i) for i, k in enumerate(hot)]
    table = spark.createDataFrame(slices, "__hot_0 string, __origin bigint, __width bigint")
    return ScanPlan(way, 7, (key,), table)


def make_rows(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        t = rng.choice([5, 5, 60, rng.randrange(100)])
        value = rng.choice([None, rng.randrange(-3, 9)])
        rows.append((key, t, i, value, rng.choice([None, -1, 0, 1])))
    return rows


def expected(rows):
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        total, last, level, values = 0, None, None, []
        moved, first_base = 0, None
        for _, _, _, value, step in mine:
            moved += step or 0
            if value is not None and first_base is None:
                first_base = value - moved
        moved = 0
        for place, (_, _, i, value, step) in enumerate(mine, 1):
            last_before, level_before = last, level
            total += value or 0
            last = value if value is not None else last
            moved += step or 0
            if value is not None:
                level = value
            elif level is not None:
                level += step or 0
            filled = level
            if filled is None and first_base is not None:
                filled = moved + first_base
            values.append(value)
            lags = [values[-1 - k] if len(values) > k else None for k in (1, 4)]
            out[i] = (place, total, last, last_before, level, level_before, filled, *lags)
    return out


@pytest.mark.parametrize("way", WAYS)
def test_operations_match_a_loop(spark, way):
    rows = make_rows()
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint, step bigint")
    got = plan_for(spark, way).compute(
        df, ["k"], ["t", "i"], "t",
        place=position(),
        total=RunningSum(F.col("v")),
        last=LastKnown(F.col("v"), before=True),
        level=Replay(F.col("v"), F.col("step"), before=True),
        filled=Replay(F.col("v"), F.col("step"), backfill=True),
        back=Lag({"v": F.col("v")}, [4, 1]),
    )
    names = ["place", "total", "last", "last_before", "level", "level_before", "filled",
             "v_lag_1", "v_lag_4"]
    found = {r.i: tuple(r[n] for n in names) for r in got.collect()}
    assert found == expected(rows)


@pytest.mark.parametrize("way", ["whole", "range"])
def test_one_global_order(spark, way):
    df = spark.range(100).withColumn("x", F.col("id") * 37 % 101)
    got = plan_for(spark, way).compute(df, [], ["x"], place=position()).orderBy("x").collect()
    assert [r.place for r in got] == list(range(1, 101))


@pytest.mark.parametrize("way", WAYS)
def test_no_rows(spark, way):
    df = spark.createDataFrame([], "k string, t bigint, i bigint, v bigint")
    got = plan_for(spark, way).compute(df, ["k"], ["t", "i"], "t", total=RunningSum(F.col("v")))
    assert got.collect() == []


def test_measure_chooses_by_size(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    assert ScanPlan.measure(df, ["k"], "t", Limits(group_rows=500)).mode == "whole"
    small = Limits(group_rows=100, slice_rows=25)
    cut = ScanPlan.measure(df, ["k"], "t", small)
    assert cut.mode == "time" and cut.hot.count() == 2
    small_keys, hot = cut.split(df.union(spark.createDataFrame([(9, 1), (None, 2)], "k bigint, t bigint")))
    assert small_keys.count() == 2 and hot.count() == 1000
    # Keys at very different times, as sessions of different days are.
    apart = df.withColumn("t", F.col("t") + F.col("k") * 10**15)
    assert ScanPlan.measure(apart, ["k"], "t", small).mode == "time"
    assert ScanPlan.measure(df, ["k"], None, small).mode == "range"
    burst = df.withColumn("t", F.when(F.col("t") < 900, 5).otherwise(F.col("t")))
    assert ScanPlan.measure(burst, ["k"], "t", small).mode == "range"
    assert ScanPlan.measure(df.filter("k = 7"), ["k"], "t", small).mode == "whole"


def test_lag_offsets_must_be_positive():
    with pytest.raises(ValueError):
        Lag({}, [0, 1])


@pytest.mark.parametrize("way", WAYS)
def test_asof_counts_equal_times(spark, way):
    states = [("q", 10, 1, 5), ("q", 10, 2, 6), ("q", 30, 9, None), ("q", 40, 3, 8), ("p", 1, 4, 1)]
    probes = [("q", t, f"p{t}") for t in (9, 10, 11, 30, 40, 99)] + [("none", 50, "x")]
    got = asof_lookup(
        spark.createDataFrame(probes, "q string, t bigint, name string"),
        spark.createDataFrame(states, "q string, t bigint, seq bigint, len bigint"),
        ["q"], "t", {"len": 0}, "seq", plan_for(spark, way, "q", ["q"]),
    )
    assert {r.name: r.len for r in got.collect()} == {
        "p9": 0, "p10": 6, "p11": 6, "p30": 6, "p40": 8, "p99": 8, "x": 0,
    }


def test_last_per_key(spark):
    rows = [("a", 1, 1, "x"), ("a", 1, 2, None), ("b", 5, 0, "z"), ("b", 4, 9, "y")]
    df = spark.createDataFrame(rows, "k string, t int, seq int, v string")
    got = {tuple(r) for r in last_per_key(df, ["k"], ["t", "seq"]).collect()}
    assert got == {("a", 1, 2, None), ("b", 5, 0, "z")}


def test_tasks_and_ranges_follow_the_rows(spark):
    """Slices are spread over tasks in proportion, and tiny limits do not make a range of every few rows."""
    df = spark.range(4000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    by_time = ScanPlan.measure(df, ["k"], "t", Limits(group_rows=500, slice_rows=100))
    assert by_time.mode == "time" and by_time.spread(df, ["k", "t"]).rdd.getNumPartitions() == 10
    tiny = ScanPlan.measure(df, ["k"], None, Limits(group_rows=4, slice_rows=1))
    assert tiny.mode == "range" and tiny.slices == 1000
    assert ScanPlan.measure(df, ["k"], None, Limits(group_rows=4, slice_rows=8)).slices == 500


def test_entered_lags_are_no_longer_than_the_longest(spark):
    """A slice is entered with the rows that a lag can reach, not with those of all slices they may lie in."""
    df = spark.range(60).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    ends = df.select("k", (F.col("t") / 10).cast("bigint").alias("__slice"), "t", F.col("t").alias("__back_v"))
    carried = _carry(ends, ["k"], ["t"], {"back": Lag({"v": F.col("t")}, [3])}, "__key")
    assert carried.agg(F.max(F.size("__back_in"))).first()[0] == 3


def test_lags_count_in_the_plan_of_the_log(spark, tmp_path):
    """A request is looked at once more for each lag, so the same log is sliced earlier with lags."""
    rows = spark.range(800).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 16).alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    limits = Limits(group_rows=200, slice_rows=50)
    assert measured(spark, str(tmp_path), limits).is_whole
    assert measured(spark, str(tmp_path), limits, slack=4).mode == "time"


def test_ends_of_slices_are_read_once_for_all_passes(spark, monkeypatch):
    """Every pass read all stored rows for the few that end its slices."""
    stored = []
    monkeypatch.setattr(scan, "cut_lineage", lambda df: stored.append(df.count()) or cut_lineage(df))
    rows = spark.createDataFrame(make_rows(), "k string, t bigint, i bigint, v bigint, s bigint")
    passes = [(["k"], {"n": position()}), (["k", "s"], {"m": position()})]
    got = plan_for(spark, "time").compute_all(rows, passes, ["t", "i"], "t").collect()
    whole = plan_for(spark, "whole").compute_all(rows, passes, ["t", "i"], "t").collect()
    assert sorted(map(str, got)) == sorted(map(str, whole))
    assert len(stored) == 2 and stored[0] == 300 and stored[1] < 150


def test_a_large_log_is_stored_in_tasks_that_keep_all_cores_busy(spark):
    plan = ScanPlan.measure(adapter.raw_events(spark, DATA), ["session_id"], "ts_ns", Limits(100, 50))
    log = adapter.worker_log(spark, DATA, plan)
    assert not plan.is_whole and log.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(map(str, log.collect())) == sorted(map(str, adapter.worker_log(spark, DATA, ScanPlan()).collect()))
