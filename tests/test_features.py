"""Feature tables against a loop over the records, and their invariants."""

import pytest
from pyspark.sql import functions as F

from tests import simulated
from queuescope import vocab
from queuescope.operators import queues as Q
from queuescope.operators import traces as T
from queuescope.operators.arrivals import running_at_arrivals
from queuescope.operators.scan import Limits, ScanPlan
from queuescope.operators.sequences import session_sequences
from queuescope.plans.features import arrival_features

LAGS = [1, 3, 5]
LIMITS = {
    "whole": Limits(),
    "time": Limits(group_rows=110, slice_rows=60),
    "range": Limits(group_rows=5, slice_rows=40),
}


@pytest.fixture(scope="module")
def log():
    return simulated.make_log()


@pytest.fixture(scope="module")
def events(spark, log):
    return simulated.as_frame(spark, log).cache()


def plan_of(events, way):
    plan = ScanPlan.measure(events, ["session_id"], "ts_ns", LIMITS[way])
    assert plan.mode == way
    return plan


@pytest.mark.parametrize("way", LIMITS)
def test_features_match_a_loop(events, log, way):
    got = arrival_features(events, None, LAGS, plan_of(events, way)).collect()
    wanted = simulated.features_by_loop(log, LAGS)
    assert {(r.session_id, r.tid) for r in got} == set(wanted) and len(got) == len(wanted)
    for r in got:
        row = r.asDict()
        expect = wanted[r.session_id, r.tid]
        assert {k: row[k] for k in expect} == expect


def test_invariants(events):
    got = arrival_features(events, None, LAGS, plan_of(events, "whole")).collect()
    for r in got:
        flags = r.is_status_Active + r.is_status_Inactive + r.is_status_Throttled
        assert flags == (r.target_queue_status in vocab.QUEUE_STATES)
        assert r.others_len_queue >= 0 and r.target_queue_len >= 0
        assert r.iat >= 0 and r.iat_fqdn >= r.iat or r.iat_fqdn == 0
    assert not any(r.session_id == 2 for r in got), "a session without GPU requests has no rows"


def test_small_sessions_keep_the_single_exchange(events):
    """One hot session is sliced; the others go through the plain plan."""
    sizes = {r.session_id: r["count"] for r in events.groupBy("session_id").count().collect()}
    hot = max(sizes, key=lambda s: (sizes[s], s))
    more = events.filter(F.col("session_id") == hot)
    for k in range(1, 4):
        shifted = events.filter(F.col("session_id") == hot).withColumns(
            {"seq": F.col("seq") + k * 100_000, "ts_ns": F.col("ts_ns") + k * 10**12, "tid": F.concat("tid", F.lit(f"x{k}"))}
        )
        more = more.unionByName(shifted)
    mixed = events.filter(F.col("session_id") != hot).unionByName(more)
    plan = ScanPlan.measure(mixed, ["session_id"], "ts_ns", Limits(group_rows=max(sizes.values()) + 1, slice_rows=100))
    assert plan.mode != "whole" and plan.hot.count() == 1
    small, large = plan.split(mixed)
    assert {r.session_id for r in large.select("session_id").distinct().collect()} == {hot}
    text = arrival_features(small, None, LAGS, ScanPlan())._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    columns = ["session_id", "tid", "iat", "target_queue_len", "others_len_queue", "num_running_funcs_filled"]
    whole = arrival_features(mixed, None, LAGS, ScanPlan()).select(*columns).collect()
    assert sorted(map(str, arrival_features(mixed, None, LAGS, plan).select(*columns).collect())) == sorted(map(str, whole))


def test_running_count_without_any_report_is_unknown(events, log):
    got = running_at_arrivals(events, ScanPlan()).collect()
    assert {r.num_running_funcs_filled for r in got if r.session_id == 1} == {None}
    arrivals = [r for r in log if r["message"] == vocab.ARRIVAL]
    assert len(got) == len(arrivals)


@pytest.mark.parametrize("way", LIMITS)
def test_wide_queue_columns_agree_with_features(events, way):
    plan = plan_of(events, way)
    features = {
        (r.session_id, r.tid): r for r in arrival_features(events, None, (), plan).collect()
    }
    states = Q.queue_states(Q.queue_events(T.tag_traces(events, plan)), plan)
    requests = T.arrivals_with_outcome(events).withColumnRenamed("invocation_ts_ns", "ts_ns")
    queues = [*simulated.FUNCTIONS, "never-used-9"]
    wide = Q.queue_columns(states, requests, plan, queues).collect()
    assert len(wide) == len(features)
    for r in wide:
        f = features[r.session_id, r.tid]
        total = sum(r[f"{q}_len"] for q in queues)
        assert total == f.target_queue_len + f.others_len_queue
        if f.fqdn in queues:
            assert r[f"{f.fqdn}_len"] == f.target_queue_len
            assert r[f"{f.fqdn}_status"] == f.target_queue_status


def test_a_log_without_queue_records(spark, events):
    plain = events.filter(~F.col("message").isin(vocab.SWITCH, vocab.START))
    got = arrival_features(plain, None, [1]).collect()
    assert got
    assert {(r.target_queue_len, r.target_queue_status, r.others_len_queue) for r in got} == {
        (0, vocab.INITIAL_STATE, 0)
    }


def test_empty_log(spark, events):
    assert arrival_features(events.filter("session_id < 0"), None, LAGS).collect() == []


def test_gpu_records_and_cold_starts(events, log):
    gpu = {
        (r["session_id"], r["tid"]) for r in log
        if r["tid"] and r["fqdn"] and r["e2etime"] is not None and r["compute"] == vocab.GPU
    }
    kept = {r.seq for r in T.gpu_records(events).collect()}
    assert kept == {r["seq"] for r in log if (r["session_id"], r["tid"]) in gpu}
    unnamed = events.withColumn("fqdn", F.lit(None).cast("string"))
    assert T.gpu_traces(unnamed).count() == 0
    assert T.gpu_traces(unnamed, need_fqdn=False).count() == len(gpu)


@pytest.mark.parametrize("way", LIMITS)
def test_sequences_are_whole_and_ordered(events, way):
    plan = plan_of(events, way)
    features = arrival_features(events, None, (), ScanPlan())
    packed = session_sequences(features, ["invocation_ts_ns", "tid"], plan, part_rows=7).collect()
    for s in {r.session_id for r in packed}:
        parts = sorted((r for r in packed if r.session_id == s), key=lambda r: r.part)
        assert all(r.length == 7 for r in parts[:-1]) and 0 < parts[-1].length <= 7
        steps = [tuple(x) for r in parts for x in r.steps]
        rows = features.filter(F.col("session_id") == s).select("invocation_ts_ns", "seq", "tid").collect()
        assert steps == [(t, tid) for t, _, tid in sorted(map(tuple, rows))]
