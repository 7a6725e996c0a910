"""Operators on traces: all records of one request share (session_id, tid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuescope import vocab
from queuescope.operators.scan import ScanPlan

TRACE = ["session_id", "tid"]


def is_gpu_outcome() -> Column:
    return F.coalesce(
        F.col("fqdn").isNotNull()
        & F.col("e2etime").isNotNull()
        & (F.col("compute") == vocab.GPU),
        F.lit(False),
    )


def trace_attributes() -> dict[str, Column]:
    """Aggregates over the records of one trace."""
    order = ["ts_ns", "seq"]
    return {
        "trace_fqdn": F.max("fqdn"),
        "is_gpu": F.max(is_gpu_outcome()),
        "is_cold_start": F.max(F.coalesce(F.col("message") == vocab.COLD_START, F.lit(False))),
        "arrival": F.min(F.when(F.col("message") == vocab.ARRIVAL, F.struct(*order))),
        "outcome": F.max(
            F.when(F.col("e2etime").isNotNull(), F.struct(*order, "fqdn", "e2etime"))
        ),
    }


def trace_table(events: DataFrame) -> DataFrame:
    """One row per trace: function, GPU flag, cold-start flag, first arrival, last outcome.

    A partial aggregate: a trace with very many records is reduced before the shuffle.
    """
    attributes = trace_attributes()
    return (
        events.filter("tid is not null")
        .groupBy(*TRACE)
        .agg(*[a.alias(name) for name, a in attributes.items()])
    )


def tag_traces(events: DataFrame, plan: ScanPlan) -> DataFrame:
    """Give each record its trace's attributes, and mark GPU arrivals (one per trace).

    While every session fits one task the attributes are window aggregates inside the session's
    partition, without a further exchange. Otherwise the small trace table is joined back, and
    adaptive execution splits a hot trace.
    """
    attributes = trace_attributes()
    if plan.is_whole:
        window = Window.partitionBy(*TRACE)
        tagged = events.withColumns({name: a.over(window) for name, a in attributes.items()})
    else:
        tagged = _join_traces(events, trace_table(events)).select(*events.columns, *attributes)
    known = F.col("tid").isNotNull()
    first = (F.col("ts_ns") == F.col("arrival.ts_ns")) & (F.col("seq") == F.col("arrival.seq"))
    is_arrival = known & F.col("is_gpu") & (F.col("message") == vocab.ARRIVAL) & first
    return tagged.select(
        *events.columns,
        F.when(known, F.col("trace_fqdn")).alias("trace_fqdn"),
        F.coalesce(is_arrival, F.lit(False)).alias("is_gpu_arrival"),
        F.when(known, F.col("outcome.fqdn")).alias("outcome_fqdn"),
        F.when(known, F.col("outcome.e2etime")).alias("outcome_e2etime"),
        F.coalesce(known & F.col("is_cold_start"), F.lit(False)).cast("int").alias("is_cold_start"),
    )


def gpu_traces(events: DataFrame, need_fqdn: bool = True) -> DataFrame:
    """Distinct traces with a GPU outcome. ``need_fqdn=False`` also accepts unnamed functions."""
    done = F.col("e2etime").isNotNull() & (F.col("compute") == vocab.GPU)
    if need_fqdn:
        done = done & F.col("fqdn").isNotNull()
    return events.filter(done & F.col("tid").isNotNull()).select(*TRACE).distinct()


def gpu_records(events: DataFrame) -> DataFrame:
    """All records of GPU traces."""
    return events.join(gpu_traces(events), TRACE, "left_semi")


def with_cold_start(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Existence flag per request: did its trace report a container cold start?"""
    cold = (
        events.filter((F.col("message") == vocab.COLD_START) & F.col("tid").isNotNull())
        .select(*TRACE)
        .distinct()
        .withColumn("__cold", F.lit(1))
    )
    return _join_traces(requests, cold).select(
        *requests.columns, F.coalesce(F.col("__cold"), F.lit(0)).alias("is_cold_start")
    )


def _join_traces(records: DataFrame, traces: DataFrame) -> DataFrame:
    """Left join on the trace. Records without a trace match nothing and are spread by ``seq``."""
    spread = F.coalesce(F.col("tid"), F.concat(F.lit("no trace "), F.col("seq").cast("string")))
    right = traces.withColumnRenamed("tid", "__tid")
    return records.withColumn("__tid", spread).join(right, ["session_id", "__tid"], "left")


def arrivals_with_outcome(events: DataFrame) -> DataFrame:
    """GPU requests: first arrival left-joined with the last outcome, one row per trace.

    Both sides are attributes of the same trace, so one aggregate replaces the join.
    """
    return (
        trace_table(events)
        .filter(F.col("is_gpu") & F.col("arrival").isNotNull())
        .select(
            *TRACE,
            F.col("arrival.ts_ns").alias("invocation_ts_ns"),
            F.col("arrival.seq").alias("seq"),
            F.col("outcome.fqdn").alias("fqdn"),
            F.col("outcome.e2etime").alias("e2etime"),
            F.col("is_cold_start").cast("int").alias("is_cold_start"),
        )
    )
