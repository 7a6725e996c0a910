"""Traces of a stream of typed events, put out when they have been quiet for a while."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuescope import vocab
from queuescope.operators.traces import TRACE, trace_attributes

TIME = "event_time"
#: Message of the records that ``end_of_log`` makes.
END = "End of log"

#: Rows that change or read a queue: kind 0 is a change, kind 1 an arrival that reads.
QUEUE_ROW = (
    "session_id bigint, queue string, ts_ns bigint, seq bigint, kind int, set_len bigint, set_status string, "
    "take bigint, tid string"
)


def event_time(ns: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000)))


def timed(rows: DataFrame, delay: str) -> DataFrame:
    """Rows with their time as a watermark column; a row may come ``delay`` behind a newer one."""
    return rows.withColumn(TIME, event_time(F.col("ts_ns"))).withWatermark(TIME, delay)


def _row(**columns: Column) -> list[Column]:
    """The columns of ``QUEUE_ROW``; those that are not given are NULL."""
    out = []
    for part in QUEUE_ROW.split(", "):
        name, kind = part.split(" ")
        out.append(columns.get(name, F.lit(None)).cast(kind).alias(name))
    return out


def switches(events: DataFrame) -> DataFrame:
    """Set records as queue rows. They name their queue themselves, so they need no state.

    End records come along as rows without a queue, for their time.
    """
    queue, is_set = F.coalesce("queue", "fqdn"), F.col("message") == vocab.SWITCH
    own = {c: F.col(c) for c in ("session_id", "ts_ns", "seq")}
    rows = events.filter((is_set & queue.isNotNull()) | (F.col("message") == END))
    kind = F.when(is_set, 0)
    return rows.select(
        *_row(**own, queue=queue, kind=kind, set_len=F.col("queue_len"), set_status=F.col("new_state"), take=F.lit(0))
    )


def trace_rows(events: DataFrame, delay: str, idle: str) -> DataFrame:
    """Start records and GPU arrivals as queue rows, once their trace is closed.

    The function of a start record and whether an arrival counts are known from the other records of
    the trace. A trace is a session window: it closes when the watermark has passed its newest record
    by ``idle``, and its rows are put out in that batch. A record that comes later than that begins
    another trace; a record behind the watermark is dropped, and Spark counts it (see ``late_rows``).
    The end record of a log is put out with the last traces, as a row without a queue.
    """
    start = F.when(F.col("message") == vocab.START, F.struct("ts_ns", "seq"))
    closed = (
        timed(events, delay)
        .filter("tid is not null")
        .groupBy(F.session_window(TIME, idle), *TRACE)
        .agg(
            *[a.alias(name) for name, a in trace_attributes().items()],
            F.collect_list(start).alias("starts"),
            F.min(F.when(F.col("message") == END, F.struct("ts_ns", "seq"))).alias("end"),
        )
    )
    at = {"session_id": F.col("session_id")}
    taken = F.transform(
        "starts",
        lambda s: F.struct(*_row(**at, queue=F.col("trace_fqdn"), ts_ns=s["ts_ns"], seq=s["seq"], kind=F.lit(0), take=F.lit(1))),
    )
    read = F.struct(
        *_row(
            **at, queue=F.col("outcome.fqdn"), ts_ns=F.col("arrival.ts_ns"), seq=F.col("arrival.seq"), kind=F.lit(1),
            take=F.lit(0), tid=F.col("tid"),
        )
    )
    counts = F.coalesce(F.col("is_gpu"), F.lit(False)) & F.col("arrival").isNotNull()
    over = F.struct(*_row(ts_ns=F.col("end.ts_ns"), seq=F.col("end.seq")))
    rows = F.concat(
        F.when(F.col("trace_fqdn").isNotNull(), taken).otherwise(F.array()),
        F.when(counts, F.array(read)).otherwise(F.array()),
        F.when(F.col("end").isNotNull(), F.array(over)).otherwise(F.array()),
    )
    return closed.select(F.explode(rows).alias("row")).select("row.*")


def end_of_log(events: DataFrame, last_ns: int, delay_ns: int, idle_ns: int) -> DataFrame:
    """Two records that close a finished log whose newest record is at ``last_ns``; batch, like ``events``.

    A stream never knows that it is over: the newest records stay behind the watermark. The first
    record lies far enough behind them to close the replay, the second closes all traces.
    """
    step = delay_ns + idle_ns + 1_000_000_000
    spark = events.sparkSession
    ends = [(None, -k, last_ns + k * step, "end", END) for k in (1, 2)]
    rows = spark.createDataFrame(ends, "session_id bigint, seq bigint, ts_ns bigint, tid string, message string")
    missing = [F.lit(None).cast(kind).alias(c) for c, kind in events.dtypes if c not in rows.columns]
    return rows.select("*", *missing).select(*events.columns).coalesce(1)
