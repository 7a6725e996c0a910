"""Random worker logs, and what a plain loop over their records gives."""

import random
from collections import defaultdict

from pyspark.sql import types as T

from queuescope import vocab

FUNCTIONS = ["cupy-4-0.0.1", "torch_rnn-1-0.0.1", "ffmpeg-1-0.0.1", "7zip-1"]
SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("tid", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("fqdn", T.StringType()),
        T.StructField("queue", T.StringType()),
        T.StructField("queue_len", T.LongType()),
        T.StructField("new_state", T.StringType()),
        T.StructField("num_running_funcs", T.LongType()),
        T.StructField("gpu_est_total", T.DoubleType()),
        T.StructField("e2etime", T.DoubleType()),
        T.StructField("compute", T.StringType()),
    ]
)
NAMES = SCHEMA.fieldNames()


def make_log(seed=7, sessions=4, requests=40):
    """Records with equal times, repeated arrivals and outcomes, unset queues, missing fields."""
    rng = random.Random(seed)
    rows = []
    seq = 0

    def emit(session, ts, **fields):
        nonlocal seq
        seq += 1
        row = dict.fromkeys(NAMES)
        row.update(session_id=session, seq=seq, ts_ns=ts, **fields)
        rows.append(row)

    for s in range(sessions):
        now = 1_700_000_000_000_000_000
        for i in range(requests):
            now += rng.choice([0, 0, 7, 1_000, 999_999_999])
            tid, fqdn = f"t{i}", rng.choice(FUNCTIONS)
            cpu = s == 2 or rng.random() < 0.2
            emit(s, now, tid=tid, message=vocab.ARRIVAL, fqdn=rng.choice([fqdn, None]))
            if rng.random() < 0.1:
                emit(s, now + rng.choice([0, 5]), tid=tid, message=vocab.ARRIVAL)
            if rng.random() < 0.5:
                queue = rng.choice([*FUNCTIONS[:3], "never-used-9"])
                named = {"queue": queue} if rng.random() < 0.7 else {"fqdn": queue}
                emit(
                    s, now + rng.choice([0, 0, 3]), message=vocab.SWITCH,
                    queue_len=rng.choice([None, 0, 1, 2, 5]),
                    new_state=rng.choice([*vocab.QUEUE_STATES, "Odd", None]), **named,
                )
            if rng.random() < 0.05:
                emit(s, now, message=vocab.SWITCH, queue_len=3)
            if rng.random() < 0.9:
                seen = rng.randrange(5) if s != 1 and rng.random() < 0.3 else None
                emit(s, now + rng.choice([0, 11]), tid=tid, message=vocab.START,
                     num_running_funcs=seen)
            if rng.random() < 0.3:
                emit(s, now + 1, tid=tid, message=vocab.COLD_START)
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                emit(
                    s, now + rng.choice([0, 20, 5_000]), tid=tid, message=vocab.COMPLETE,
                    fqdn=fqdn, e2etime=rng.choice([None, 0.0, round(rng.random() * 9, 3)]),
                    compute="CPU" if cpu else vocab.GPU,
                )
        emit(s, now, message="Other", tid=None, num_running_funcs=None)
    rng.shuffle(rows)
    return rows


def as_frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], SCHEMA)


def running_by_loop(session_rows):
    """seq -> requests in flight, for all records that count."""
    count, offset, first, raw = 0, None, None, []
    for r in sorted(session_rows, key=lambda r: (r["ts_ns"], r["seq"])):
        told = r["num_running_funcs"] is not None
        known = told or r["e2etime"] is not None
        if not (known or r["message"] in (vocab.START, vocab.ARRIVAL)):
            continue
        if r["message"] == vocab.ARRIVAL:
            count += 1
        elif r["message"] == vocab.COMPLETE:
            count -= 1
        if told:
            offset = r["num_running_funcs"] - count
            first = offset if first is None else first
        raw.append((r["seq"], count, offset))
    return {
        seq: None if first is None else c + (first if o is None else o) for seq, c, o in raw
    }


def features_by_loop(rows, lags):
    """(session, tid) -> feature dict, one record after the other."""
    out = {}
    sessions = defaultdict(list)
    for r in rows:
        sessions[r["session_id"]].append(r)
    for session, members in sessions.items():
        members.sort(key=lambda r: (r["ts_ns"], r["seq"]))
        name, gpu, cold, outcome, arrival = {}, set(), set(), {}, {}
        for r in members:
            tid = r["tid"]
            if tid is None:
                continue
            if r["fqdn"] is not None:
                name[tid] = max(name.get(tid, ""), r["fqdn"])
            if r["fqdn"] is not None and r["e2etime"] is not None and r["compute"] == vocab.GPU:
                gpu.add(tid)
            if r["message"] == vocab.COLD_START:
                cold.add(tid)
            if r["e2etime"] is not None:
                outcome[tid] = r
            if r["message"] == vocab.ARRIVAL:
                arrival.setdefault(tid, r)
        arriving = {r["seq"] for t, r in arrival.items() if t in gpu}
        running = running_by_loop(members)

        length, status = defaultdict(int), {}
        history, last_any, last_by_name = [], None, {}
        in_turn = sorted(
            (r for r in members if r["message"] in (vocab.SWITCH, vocab.START)
             or r["seq"] in arriving),
            key=lambda r: (r["ts_ns"], r["seq"] in arriving, r["seq"]),
        )
        for r in in_turn:
            if r["message"] == vocab.SWITCH:
                q = r["queue"] or r["fqdn"]
                if q is None:
                    continue
                if r["queue_len"] is not None:
                    length[q] = r["queue_len"]
                if r["new_state"] is not None:
                    status[q] = r["new_state"]
            elif r["message"] == vocab.START:
                q = name.get(r["tid"])
                if q is not None:
                    length[q] = max(0, length[q] - 1)
            else:
                tid, fqdn = r["tid"], outcome[r["tid"]]["fqdn"]
                own = length[fqdn] if fqdn in length else 0
                f = {
                    "invocation_ts_ns": r["ts_ns"],
                    "fqdn": fqdn,
                    "e2etime": outcome[tid]["e2etime"],
                    "iat": 0.0 if last_any is None else (r["ts_ns"] - last_any) / 1e9,
                    "iat_fqdn": (
                        0.0 if fqdn not in last_by_name
                        else (r["ts_ns"] - last_by_name[fqdn]) / 1e9
                    ),
                    "num_running_funcs_filled": (
                        None if running[r["seq"]] is None else running[r["seq"]] - 1
                    ),
                    "target_queue_len": own,
                    "target_queue_status": status.get(fqdn, vocab.INITIAL_STATE),
                    "others_len_queue": sum(length.values()) - own,
                    "is_cold_start": int(tid in cold),
                }
                now = (dict(length), sum(length.values()), f["num_running_funcs_filled"])
                for k in lags:
                    then = history[-k] if len(history) >= k else ({}, 0, 0)
                    mine = then[0].get(fqdn, 0)
                    f[f"target_queue_len_lag_{k}"] = mine
                    f[f"others_len_queue_lag_{k}"] = then[1] - mine
                    f[f"num_running_funcs_filled_lag_{k}"] = then[2] or 0
                history.append(now)
                last_any = last_by_name[fqdn] = r["ts_ns"]
                out[session, tid] = f
    return out
