"""Wide export of many queues against a loop."""

import random

import pytest

from queuescope import vocab
from queuescope.operators import queues as Q
from queuescope.operators.scan import Limits, ScanPlan

STATES = "session_id bigint, queue string, ts_ns bigint, seq bigint, len bigint, status string"
ARRIVALS = "session_id bigint, tid string, ts_ns bigint, seq bigint"


def history(queues, changes, arrivals, seed=4):
    rng = random.Random(seed)
    states, reads, seq = [], [], 0
    for s in (1, 2, 3):
        for _ in range(changes if s != 3 else 0):
            seq += 1
            states.append((s, f"q{rng.randrange(queues)}", rng.randrange(900), seq, rng.randrange(9), rng.choice(vocab.QUEUE_STATES)))
        for k in range(arrivals if s != 2 else 0):
            seq += 1
            reads.append((s, f"t{k}", rng.randrange(1000), seq))
    return states, reads


def by_loop(states, reads, names):
    out = []
    for s, tid, ts, seq in reads:
        known = {}
        for _, q, _, _, n, status in sorted((x for x in states if x[0] == s and x[2] <= ts), key=lambda x: (x[2], x[3])):
            known[q] = (n, status)
        each = [known.get(q, (0, vocab.INITIAL_STATE)) for q in names]
        out.append((s, tid, ts, seq, [n for n, _ in each], [x for _, x in each]))
    return sorted(out)


def frames(spark, states, reads):
    return spark.createDataFrame(states, STATES), spark.createDataFrame(reads, ARRIVALS)


@pytest.mark.parametrize("limits", [Limits(), Limits(group_rows=40, slice_rows=25), Limits(group_rows=5, slice_rows=20)])
def test_maps_match_a_loop(spark, monkeypatch, limits):
    monkeypatch.setattr(Q, "SPREAD", 7)
    states, reads = history(12, 150, 60)
    s, a = frames(spark, states, reads)
    stacked = s.select("session_id", "ts_ns").union(a.select("session_id", "ts_ns"))
    plan = ScanPlan.measure(stacked, ["session_id"], "ts_ns", limits)
    names = [f"q{k}" for k in range(14)]
    rows = Q.wide_arrays(Q.queue_maps(s, a, plan), names).collect()
    assert sorted(tuple(r) for r in rows) == by_loop(states, reads, names)


def test_two_thousand_queues_in_one_pass(spark):
    few, many = history(3, 40, 20), history(2000, 3000, 30)
    maps = {n: Q.queue_maps(*frames(spark, *h), ScanPlan()) for n, h in ((3, few), (2000, many))}
    nodes = {n: m._jdf.queryExecution().optimizedPlan().toString().count("\n") for n, m in maps.items()}
    assert nodes[3] == nodes[2000]
    names = [f"q{k}" for k in range(2000)]
    rows = Q.wide_arrays(maps[2000], names).collect()
    assert sorted(tuple(r) for r in rows) == by_loop(*many, names)


def test_intervals_are_as_few_as_the_changes_that_are_seen(spark):
    states, reads = history(2000, 3000, 30)
    intervals, placed = Q.queue_intervals(*frames(spark, states, reads), ScanPlan())
    assert intervals.count() <= len(states) and placed.count() == len(reads)
    none, _ = Q.queue_intervals(*frames(spark, states, reads[:0]), ScanPlan())
    assert none.count() == 0
