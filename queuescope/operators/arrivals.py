"""Ordered operators over the arrivals and records of a session."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope import vocab
from queuescope.functions.fields import seconds_between
from queuescope.operators.scan import Lag, Replay, ScanPlan


def with_gap(
    df: DataFrame,
    plan: ScanPlan,
    keys: Sequence[str],
    out: str,
    time: str = "ts_ns",
    seq: str = "seq",
    offsets: Iterable[int] = (),
) -> DataFrame:
    """Seconds since the previous row of the key, 0 for the first.

    ``offsets`` also keeps the times of the rows that many places earlier, as ``time_lag_<k>``.
    """
    extra = sorted(set(offsets))
    lagged = plan.compute(
        df, keys, [time, seq], time, gap=Lag({"__time": F.col(time)}, [1, *extra])
    )
    gap = F.coalesce(seconds_between(F.col(time), F.col("__time_lag_1")), F.lit(0.0))
    return lagged.select(
        *df.columns,
        gap.alias(out),
        *[F.col(f"__time_lag_{k}").alias(f"time_lag_{k}") for k in extra],
    )


def running_count(backfill: bool = True) -> Replay:
    """Requests in flight at a record, as an operation over a session's records.

    The log reports the count only now and then. Between reports it moves by +1 per arrival and -1
    per completion; before the first report it is extended backwards (unknown without ``backfill``).
    All requests count, GPU or not. A completion that carries neither a latency nor a count does not
    move it.
    """
    counted = F.col("num_running_funcs").isNotNull() | F.col("e2etime").isNotNull()
    step = (
        F.when(F.col("message") == vocab.ARRIVAL, 1)
        .when((F.col("message") == vocab.COMPLETE) & counted, -1)
        .otherwise(0)
        .cast("bigint")
    )
    return Replay(F.col("num_running_funcs"), step, backfill=backfill)


def with_running_count(events: DataFrame, plan: ScanPlan, backfill: bool = True) -> DataFrame:
    """Requests in flight at each record, as ``running``."""
    return plan.compute(
        events, ["session_id"], ["ts_ns", "seq"], "ts_ns", running=running_count(backfill)
    )


def running_at_arrivals(events: DataFrame, plan: ScanPlan) -> DataFrame:
    """Per arrival record, the other requests in flight (the new one is left out)."""
    relevant = events.filter(
        F.col("num_running_funcs").isNotNull()
        | F.col("e2etime").isNotNull()
        | F.col("message").isin(vocab.START, vocab.ARRIVAL)
    )
    return (
        with_running_count(relevant, plan)
        .filter(F.col("message") == vocab.ARRIVAL)
        .select(
            "session_id", "tid", "ts_ns", "seq",
            (F.col("running") - 1).alias("num_running_funcs_filled"),
        )
    )
