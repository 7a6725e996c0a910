"""The streaming replay against the batch operators."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from queuescope import vocab
from queuescope.operators import queues as Q
from queuescope.operators import traces as T
from queuescope.operators.asof import asof_lookup
from queuescope.operators.scan import ScanPlan
from queuescope.registry import queries
from queuescope.streaming.jobs import ReplayJob
from queuescope.streaming.replay import _WAITING, _step, at_arrivals, history, late_rows
from queuescope.streaming.traces import end_of_log
from tests import simulated

SECOND = 1_000_000_000
DELAY, IDLE, SETTLE = 3, 5, 12


def batch(events):
    plan = ScanPlan()
    states = Q.queue_states(Q.queue_events(T.tag_traces(events, plan)), plan)
    requests = T.arrivals_with_outcome(events)
    probes = requests.select("session_id", "tid", requests.invocation_ts_ns.alias("ts_ns"), requests.fqdn.alias("queue"))
    values = {"len": 0, "status": vocab.INITIAL_STATE}
    found = asof_lookup(probes, states, Q.QUEUE, "ts_ns", values, "seq", plan)
    return as_rows(states.select("session_id", "queue", "ts_ns", "seq", "change", "len", "status", "delta")), as_rows(found)


def as_rows(frame):
    columns = sorted(frame.columns)
    return sorted([tuple(str(r[c]) for c in columns) for r in frame.collect()])


def pieces(rows, number, seed=1):
    """The records in about the order of time, each up to ``DELAY`` out of it, cut in equal pieces."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r["ts_ns"] + rng.random() * 0.9 * DELAY * SECOND)
    size = -(-len(order) // number)
    return [order[k : k + size] for k in range(0, len(order), size)]


@pytest.fixture
def job(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    (tmp_path / "events").mkdir()
    seconds = [f"{n} seconds" for n in (DELAY, IDLE, SETTLE)]
    yield ReplayJob(spark, f"{tmp_path}/events", simulated.SCHEMA, f"{tmp_path}/out", *seconds, files=1)
    spark.conf.set("spark.sql.shuffle.partitions", old)


def append(job, rows):
    frame = rows if hasattr(rows, "write") else simulated.as_frame(job.spark, rows)
    frame.coalesce(1).write.mode("append").parquet(job.events)


def ends(spark, rows):
    empty = simulated.as_frame(spark, [])
    return end_of_log(empty, max(r["ts_ns"] for r in rows), DELAY * SECOND, (IDLE + SETTLE) * SECOND)


def test_pieces_and_a_restart_give_the_batch_rows(spark, job):
    rows = simulated.make_log(seed=11, sessions=3, requests=400)
    cut = pieces(rows, 5)
    for part in cut[:3]:
        append(job, part)
    early = job.run()
    states, found = batch(simulated.as_frame(spark, rows))
    first = as_rows(history(early))
    assert 0 < len(first) < len(states) and set(first) <= set(states)
    for part in cut[3:]:
        append(job, part)
    append(job, ends(spark, rows))
    again = ReplayJob(**{**vars(job), "queries": []})  # another process that knows the folders only
    done = again.run()
    assert as_rows(history(done)) == states
    assert as_rows(at_arrivals(done).select("session_id", "tid", "ts_ns", "queue", "len", "status")) == found
    assert sum(late_rows(q) for q in job.queries + again.queries) == 0


def test_late_records_are_dropped_and_counted(spark, job):
    rows = [r for r in simulated.make_log(seed=3, sessions=1, requests=60) if r["message"] == vocab.SWITCH]
    append(job, rows)
    append(job, ends(spark, rows))
    before = as_rows(history(job.run()))
    assert before == batch(simulated.as_frame(spark, rows))[0]
    append(job, [{**rows[0], "seq": 10_000, "queue_len": 9}])
    assert as_rows(history(job.run())) == before
    assert late_rows(job.queries[-1]) == 1


def events_table(spark, folder, rows, seed):
    """An events table of few users, with times that repeat and missing fields."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    kinds = ["click", "view", "purchase", "signup", "error"]
    made = [
        (
            n, start + timedelta(seconds=rng.randrange(rows)), rng.randrange(12), rng.choice(kinds), rng.random(),
            rng.choice(['{"k": %d}' % rng.randrange(50), "{}"]),
        )
        for n in range(rows)
    ]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_a_larger_log_is_streamed_in_more_files_and_no_more_batches(spark, tmp_path, monkeypatch):
    jobs = []

    class Spied(ReplayJob):
        def run(self):
            jobs.append(self)
            return super().run()

    monkeypatch.setattr(queries, "ReplayJob", Spied)
    monkeypatch.setattr(queries, "STREAM_ROWS", 50, raising=False)
    table = events_table(spark, tmp_path, 600, seed=5)
    found = as_rows(queries.stream_target_queue(spark, table))
    assert found and found == as_rows(queries.target_queue(spark, table))
    files = [f for f in spark.read.parquet(jobs[0].events).inputFiles()]
    assert len(files) == 2 * 6 + 1 and jobs[0].files == 6  # the last one holds the end records


def by_loop(rows, length, status):
    out = []
    for row in sorted(rows, key=lambda r: (r["ts_ns"], r["kind"], r["seq"])):
        before = length
        if row["kind"] == 0:
            if row["set_len"] is not None:
                length = row["set_len"]
            elif row["take"]:
                length = max(0, length - 1)
            status = row["set_status"] or status
        out.append((row["seq"], length, status, length - before))
    return out, length, status


def test_rows_of_a_queue_are_replayed_as_in_a_loop():
    rng = random.Random(7)
    for case in range(200):
        rows = [
            {
                "ts_ns": 2**60 + rng.randrange(20), "seq": n, "kind": rng.randrange(2),
                "set_len": rng.choice([None, None, -2, 0, 1, 4]), "set_status": rng.choice([None, "", "Active", "Throttled"]),
                "take": rng.choice([None, 0, 1]), "tid": None,
            }
            for n in range(rng.randrange(1, 30))
        ]
        length, status = rng.randrange(4), "Inactive"
        frame = pd.DataFrame(rows, columns=list(_WAITING)).astype(_WAITING)
        out, *state = _step(frame, length, status)
        expected, *expected_state = by_loop(rows, length, status)
        assert list(zip(*(out[c].tolist() for c in ("seq", "len", "status", "delta")))) == expected, case
        assert state == expected_state
