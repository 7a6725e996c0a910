"""Feature tables: system state at the arrival of each GPU request."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope import vocab
from queuescope.functions.fields import display_time, seconds_between, status_flags
from queuescope.operators.arrivals import running_count
from queuescope.operators.lags import add_lag_probes, fold_lag_probes, with_global_lags
from queuescope.operators.profiles import join_profile
from queuescope.operators.queues import replay, with_total
from queuescope.operators.scan import Lag, Limits, RunningSum, ScanPlan
from queuescope.operators.traces import tag_traces

_NEEDED = [
    "session_id", "seq", "ts_ns", "tid", "message", "fqdn", "queue", "queue_len", "new_state",
    "num_running_funcs", "e2etime", "compute",
]
#: What a session's path says; kept where the events have it.
_SESSION = ["policy", "workload"]
_ARRIVAL_COLUMNS = [
    "is_cold_start", "outcome_fqdn", "outcome_e2etime", "iat", "iat_fqdn", "running", *_SESSION,
]
_NARROW = ["session_id", "seq", "ts_ns", "kind", "queue"]


def plan_for(events: DataFrame, lags: Iterable[int] = (), limits: Limits | None = None) -> ScanPlan:
    """Measure the sessions of an event table. A request is looked at once more for each lag."""
    return ScanPlan.measure(events, ["session_id"], "ts_ns", limits, slack=1 + len(set(lags)))


def arrival_features(
    events: DataFrame,
    profile: DataFrame | None = None,
    lags: Iterable[int] = (),
    plan: ScanPlan | None = None,
    causal: bool = False,
) -> DataFrame:
    """One row per GPU request with the state it met; with ``lags`` also the state before.

    With ``causal`` no feature looks ahead: the running count is NULL before its first report, and
    ``is_cold_start`` says that the session has no earlier completion of the function.

    While sessions fit one task the whole computation runs behind a single exchange on
    ``session_id``: every step is a window on the session or on a finer key. Where some do not, only
    their rows are sliced; the others go through the single exchange as before.
    """
    lags = sorted(set(lags))
    plan = plan or plan_for(events, lags)
    if plan.is_whole:
        return _arrival_features(events, profile, lags, plan, causal)
    small, hot = plan.split(events)
    return _arrival_features(small, profile, lags, ScanPlan(), causal).unionByName(
        _arrival_features(hot, profile, lags, plan, causal)
    )


def _arrival_features(events, profile, lags: list[int], plan: ScanPlan, causal: bool) -> DataFrame:
    named = {c: F.lit(None).cast("string") for c in _SESSION if c not in events.columns}
    events = events.withColumns(named).select(*_NEEDED, *_SESSION)
    rows = plan.co_locate(events, ["session_id"])
    rows = _with_history(_relevant(tag_traces(rows, plan)), plan, lags, causal)
    rows = add_lag_probes(_state_rows(rows, lags), lags, _NARROW)
    rows = replay(rows, plan, ["probe_ns", "kind", "seq"], "probe_ns")
    rows = fold_lag_probes(rows, lags, plan if lags else None)
    rows = with_total(rows, plan, ["ts_ns", "kind", "seq"], "ts_ns")
    arrivals = rows.filter("kind = 1").withColumn(
        "num_running_funcs_filled", F.col("running") - 1
    )
    arrivals = with_global_lags(arrivals, plan, lags)
    return _named(join_profile(arrivals.withColumnRenamed("outcome_fqdn", "fqdn"), profile), lags)


def _relevant(tagged: DataFrame) -> DataFrame:
    """Records that move the running count or a queue, without columns no later step reads."""
    moves = F.col("message").isin(vocab.ARRIVAL, vocab.START, vocab.COMPLETE, vocab.SWITCH)
    return tagged.filter(moves | F.col("num_running_funcs").isNotNull()).drop("compute")


def _with_history(rows: DataFrame, plan: ScanPlan, lags, causal: bool) -> DataFrame:
    """What the records before say of an arrival, all in one pass over the session's records.

    ``iat`` and ``iat_fqdn``: seconds since the last GPU arrival, and since the last one of the same
    function; ``time_lag_<k>``; ``running``. With ``causal`` also ``is_cold_start``: no request of the
    function was completed before. Other records simply form groups of their own.
    """
    time, done = F.col("ts_ns"), F.col("message") == vocab.COMPLETE
    function = F.when(F.col("is_gpu_arrival"), F.col("outcome_fqdn")).when(done, F.col("fqdn"))
    passes = [
        (["session_id"], {"running": running_count(backfill=not causal)}),
        (["session_id", "is_gpu_arrival"], {"gap": Lag({"__time": time}, [1, *lags])}),
        (["session_id", "is_gpu_arrival", "outcome_fqdn"], {"same": Lag({"__same": time}, [1])}),
    ]
    if causal:
        finished = RunningSum(F.coalesce(done, F.lit(False)).cast("bigint"))
        passes.append((["session_id", "__function"], {"__done": finished}))
    seen = plan.compute_all(
        rows.withColumn("__function", function), passes, ["ts_ns", "seq"], "ts_ns"
    )
    if causal:
        seen = seen.withColumn("is_cold_start", (F.col("__done") == 0).cast("int"))
    gaps = {"iat": "__time_lag_1", "iat_fqdn": "__same_lag_1"}
    return seen.select(
        *rows.columns,
        "running",
        *[F.coalesce(seconds_between(time, F.col(c)), F.lit(0.0)).alias(n) for n, c in gaps.items()],
        *[F.col(f"__time_lag_{k}").alias(f"time_lag_{k}") for k in lags],
    )


def _state_rows(rows: DataFrame, lags) -> DataFrame:
    """Queue changes (kind 0) and GPU arrivals (kind 1) in one stream.

    At equal time changes come before arrivals, so an arrival sees them.
    """
    is_set = F.col("message") == vocab.SWITCH
    is_take = F.col("message") == vocab.START
    arrives = F.col("is_gpu_arrival")
    queue = (
        F.when(arrives, F.col("outcome_fqdn"))
        .when(is_set, F.coalesce("queue", "fqdn"))
        .when(is_take, F.col("trace_fqdn"))
    )
    return rows.filter(arrives | is_set | is_take).select(
        "session_id", "tid", "seq", "ts_ns", "is_gpu_arrival",
        arrives.cast("int").alias("kind"),
        queue.alias("queue"),
        F.when(is_set, F.col("queue_len")).alias("set_len"),
        F.when(is_set, F.col("new_state")).alias("set_status"),
        F.coalesce(is_take, F.lit(False)).cast("bigint").alias("take"),
        *_ARRIVAL_COLUMNS,
        *[f"time_lag_{k}" for k in lags],
    ).filter("kind = 1 or queue is not null")


def _named(rows: DataFrame, lags) -> DataFrame:
    return rows.select(
        "session_id",
        *_SESSION,
        "tid",
        "seq",
        F.col("ts_ns").alias("invocation_ts_ns"),
        display_time(F.col("ts_ns")).alias("invocation_ts"),
        "fqdn",
        "base_function",
        F.col("outcome_e2etime").alias("e2etime"),
        "iat",
        "iat_fqdn",
        "num_running_funcs_filled",
        F.col("len").alias("target_queue_len"),
        F.col("status").alias("target_queue_status"),
        (F.col("total") - F.col("len")).alias("others_len_queue"),
        *[flag.alias(name) for name, flag in status_flags(F.col("status")).items()],
        "gpu_warm_results_sec",
        "gpu_cold_results_sec",
        "is_cold_start",
        *[
            f"{name}_lag_{k}"
            for k in lags
            for name in ("target_queue_len", "others_len_queue", "num_running_funcs_filled")
        ],
    )
