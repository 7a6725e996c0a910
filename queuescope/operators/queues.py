"""Queue state: events that change it, its replay, and its value at arrivals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuescope import vocab
from queuescope.operators.asof import last_per_key
from queuescope.operators.scan import Lag, LastKnown, Replay, RunningSum, ScanPlan

QUEUE = ["session_id", "queue"]


def queue_events(tagged: DataFrame) -> DataFrame:
    """Changes of queue state, from records tagged with their trace's function.

    A switch record sets length and status of the queue it names; a start record takes one request
    off the queue of its function. Records that name no queue change nothing.
    """
    is_set = F.col("message") == vocab.SWITCH
    is_take = F.col("message") == vocab.START
    queue = F.when(is_set, F.coalesce("queue", "fqdn")).when(is_take, F.col("trace_fqdn"))
    return tagged.filter(is_set | is_take).select(
        "session_id",
        queue.alias("queue"),
        "ts_ns",
        "seq",
        F.when(is_set, "set").otherwise("dec").alias("change"),
        F.when(is_set, F.col("queue_len")).alias("set_len"),
        F.when(is_set, F.col("new_state")).alias("set_status"),
    ).filter("queue is not null")


def _clamped(level: Column, held: Column) -> Column:
    """Length from the replayed level: taking from an empty queue leaves it empty."""
    return (
        F.when(level.isNull(), F.lit(0))
        .when(level < held, F.greatest(level, F.lit(0)))
        .otherwise(level)
        .cast("bigint")
    )


def replay(
    rows: DataFrame, plan: ScanPlan, order: Sequence[str], time: str = "ts_ns"
) -> DataFrame:
    """Add ``len``, ``status`` and ``delta`` (change of length) after each row.

    Rows have ``set_len``, ``set_status``, ``take`` (1 where a request leaves); rows without a
    change just read the state. A set without a length changes the status only. Clamping the end
    value is enough, because between two sets the length only falls.
    """
    out = plan.compute(
        rows,
        QUEUE,
        order,
        time,
        level=Replay(F.col("set_len"), -F.col("take"), before=True),
        held=LastKnown(F.col("set_len"), before=True),
        status=LastKnown(F.col("set_status")),
    )
    length = _clamped(F.col("level"), F.col("held"))
    before = _clamped(F.col("level_before"), F.col("held_before"))
    return out.select(
        *rows.columns,
        length.alias("len"),
        F.coalesce("status", F.lit(vocab.INITIAL_STATE)).alias("status"),
        (length - before).alias("delta"),
    )


def queue_states(changes: DataFrame, plan: ScanPlan) -> DataFrame:
    """History of queue state, one row per change."""
    rows = changes.withColumn("take", (F.col("change") == "dec").cast("bigint"))
    return replay(rows, plan, ["ts_ns", "seq"]).drop("take")


def with_total(rows: DataFrame, plan: ScanPlan, order: Sequence[str], time: str) -> DataFrame:
    """Add ``total``: the length of all queues of the session together, after each row.

    A running sum of the changes; no row per (queue, arrival) pair is ever made.
    """
    return plan.compute(rows, ["session_id"], order, time, total=RunningSum(F.col("delta")))


def queue_columns(
    states: DataFrame, arrivals: DataFrame, plan: ScanPlan, queues: Sequence[str]
) -> DataFrame:
    """Arrivals with ``<queue>_len`` and ``<queue>_status`` for each queue in ``queues``.

    For export. The caller names the queues; one pass over states and arrivals in time order
    carries one value per column forward.
    """
    stacked = states.select(
        "session_id", "ts_ns", F.lit(0).alias("kind"), "seq", "queue", "len", "status"
    ).unionByName(
        arrivals.select("session_id", "ts_ns", F.lit(1).alias("kind"), "seq", "tid"),
        allowMissingColumns=True,
    )
    ops = {}
    for i, q in enumerate(queues):
        mine = F.col("queue") == q
        ops[f"len_{i}"] = LastKnown(F.when(mine, F.col("len")))
        ops[f"status_{i}"] = LastKnown(F.when(mine, F.col("status")))
    wide = plan.compute(stacked, ["session_id"], ["ts_ns", "kind", "seq"], "ts_ns", **ops)
    columns = []
    for i, q in enumerate(queues):
        columns.append(F.coalesce(f"len_{i}", F.lit(0)).alias(f"{q}_len"))
        columns.append(
            F.coalesce(f"status_{i}", F.lit(vocab.INITIAL_STATE)).alias(f"{q}_status")
        )
    return wide.filter("kind = 1").select("session_id", "tid", "ts_ns", "seq", *columns)


#: Arrivals that one row stands for while intervals are spread out.
SPREAD = 4096


def queue_intervals(states: DataFrame, arrivals: DataFrame, plan: ScanPlan) -> tuple[DataFrame, DataFrame]:
    """State of all queues at all arrivals as intervals, and the arrivals with their ``place`` in the session.

    An interval (session_id, queue, first, last, len, status) says what the arrivals of these places see
    in a queue. One pass in time order counts arrivals; a change ends the interval of the change before
    it, and the last change of a queue holds to the end. Changes that no arrival sees make no interval,
    so there are at most as many as changes, however many queues and arrivals there are.
    """
    stacked = states.select(
        "session_id", "ts_ns", F.lit(0).alias("kind"), "seq", "queue", "len", "status"
    ).unionByName(
        arrivals.select("session_id", "ts_ns", F.lit(1).alias("kind"), "seq", "tid"),
        allowMissingColumns=True,
    )
    counted = plan.compute(
        stacked, ["session_id"], ["ts_ns", "kind", "seq"], "ts_ns", place=RunningSum(F.col("kind").cast("bigint"))
    )
    placed = counted.filter("kind = 1").select("session_id", "tid", "ts_ns", "seq", "place")
    changes = counted.filter("kind = 0").select(
        *QUEUE, "ts_ns", "seq", "len", "status", (F.col("place") + 1).alias("first")
    )
    values = {c: F.col(c) for c in ("len", "status", "first")}
    seen = plan.compute(changes, QUEUE, ["ts_ns", "seq"], "ts_ns", was=Lag(values, [1]))
    ended = seen.select(
        *QUEUE, F.col("first_lag_1").alias("first"), (F.col("first") - 1).alias("last"),
        F.col("len_lag_1").alias("len"), F.col("status_lag_1").alias("status"),
    )
    totals = placed.groupBy("session_id").agg(F.max("place").alias("last"))
    open_ = last_per_key(changes, QUEUE, ["ts_ns", "seq"]).join(totals, "session_id")
    both = ended.unionByName(open_.select(*ended.columns))
    return both.filter("first <= last"), placed


def queue_maps(states: DataFrame, arrivals: DataFrame, plan: ScanPlan) -> DataFrame:
    """Arrivals with ``queues``: a map from the name of each queue that has changed to (len, status).

    The number of queues does not show in the plan. Intervals are cut, then spread over their arrivals,
    and a group is one arrival with its queues.
    """
    intervals, placed = queue_intervals(states, arrivals, plan)
    begin = F.explode(F.sequence("first", "last", F.lit(SPREAD)))
    cut = intervals.withColumn("__from", begin)
    until = F.least(F.col("last"), F.col("__from") + (SPREAD - 1))
    spread = cut.select(
        "session_id", F.explode(F.sequence("__from", until)).alias("place"),
        F.struct("queue", F.struct("len", "status").alias("state")).alias("entry"),
    )
    maps = spread.groupBy("session_id", "place").agg(F.map_from_entries(F.collect_list("entry")).alias("queues"))
    joined = placed.join(maps, ["session_id", "place"], "left")
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<len:bigint,status:string>>"))
    return joined.select("session_id", "tid", "ts_ns", "seq", F.coalesce("queues", nothing).alias("queues"))


def wide_arrays(rows: DataFrame, queues: Sequence[str]) -> DataFrame:
    """``queues`` of ``queue_maps`` as arrays ``lens`` and ``statuses`` in the order of the names."""
    names = F.array(*[F.lit(q) for q in queues]).cast("array<string>")
    state = lambda q: F.try_element_at("queues", q)
    return rows.select(
        "session_id", "tid", "ts_ns", "seq",
        F.transform(names, lambda q: F.coalesce(state(q)["len"], F.lit(0))).alias("lens"),
        F.transform(names, lambda q: F.coalesce(state(q)["status"], F.lit(vocab.INITIAL_STATE))).alias("statuses"),
    )
