"""The ``events`` test table read as a worker log.

The mapping is fixed, so that the DataFrame queries and their SQL twins see the same records:
a user's n-th event of each type belongs to one request, event types stand for log messages, and
eight users modulo form the sessions. It is deterministic but not causal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuescope import vocab
from queuescope.functions.fields import nanos_of_timestamp
from queuescope.operators.scan import Limits, ScanPlan, position

# Function names of the mapping, by number; any other number gives the last one.
FUNCTIONS = [
    "cupy-4-0.0.1", "torch_rnn-1-0.0.1", "pyhpc-eos-2-0.0.1", "pyhpc-isoneural-3-0.0.1",
    "ffmpeg-1-0.0.1", "7zip-1",
]

# Policy of each session number.
SESSION_POLICIES = [
    "Landlord", "AlwaysGPU", "AlwaysCPU", "Greedy", "MICE", "NEW_MICE", "WeightedRandom_0.5",
    "Speedup",
]

#: Tasks for each core in which a large log is numbered and stored.
TASKS_PER_CORE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, names: list) -> Column:
    """``names[index]``, and the last name for any other index."""
    out = F.when(index == 0, names[0])
    for i, n in enumerate(names[1:-1], start=1):
        out = out.when(index == i, n)
    return out.otherwise(names[-1])


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with session, nanoseconds, and the integer ``k`` of ``props``."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 8).alias("session_id"),
        nanos_of_timestamp(events, "ts").alias("ts_ns"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def measured(
    spark: SparkSession, sf_dir: str, limits: Limits | None = None, slack: int = 1
) -> ScanPlan:
    """Scan plan of the log, whose sessions and times are those of the raw events.

    The number of all rows comes from the file footers. Where even that fits one task, sessions need
    not be counted.
    """
    limits = limits or Limits.of(spark)
    if table(spark, sf_dir, "events").count() <= limits.group_rows // slack:
        return ScanPlan()
    return ScanPlan.measure(raw_events(spark, sf_dir), ["session_id"], "ts_ns", limits, slack)


def worker_log(
    spark: SparkSession, sf_dir: str, plan: ScanPlan | None = None, kinds: tuple[str, ...] = ()
) -> DataFrame:
    """Typed event table; with ``kinds``, of these event types only.

    Requests are numbered per user and type, so other types can be left out before the numbering,
    and the filter reaches the file scan. Where sessions are sliced, users may still fit one task, and
    then their rows need no slices.
    """
    raw = raw_events(spark, sf_dir)
    plan = plan or measured(spark, sf_dir)
    if kinds:
        raw = raw.filter(F.col("event_type").isin(*kinds))
    keys = ["user_id", "event_type"]
    numbering = plan if plan.is_whole else ScanPlan.measure(raw, keys, "ts_ns")
    if numbering.is_whole and not plan.is_whole:
        # The log is stored and read several times then: tasks of a size that keeps all cores busy to the end.
        raw = raw.repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, *keys)
    numbered = numbering.compute(raw, keys, ["ts_ns", "seq"], "ts_ns", n=position())
    kind, k, user, n = (F.col(c) for c in ("event_type", "k", "user_id", "n"))
    message = (
        F.when(kind == "click", vocab.ARRIVAL)
        .when(kind == "view", vocab.START)
        .when(kind == "purchase", vocab.COMPLETE)
        .when(kind == "signup", vocab.SWITCH)
        .when((kind == "error") & (k % 3 == 0), vocab.COLD_START)
        .otherwise("Other")
    )
    return numbered.select(
        "session_id",
        pick(F.col("session_id"), SESSION_POLICIES).alias("policy"),
        F.concat(F.lit("load-"), (F.col("session_id") % 3).cast("string")).alias("workload"),
        "seq",
        "ts_ns",
        F.concat_ws("-", user.cast("string"), n.cast("string")).alias("tid"),
        message.alias("message"),
        F.when(kind.isin("click", "purchase"), pick((user + n) % 6, FUNCTIONS)).alias("fqdn"),
        F.when(kind == "signup", pick(k % 6, FUNCTIONS)).alias("queue"),
        F.when(kind == "signup", k % 7).cast("bigint").alias("queue_len"),
        F.when(kind == "signup", pick(k % 4, [*vocab.QUEUE_STATES, None])).alias("new_state"),
        F.when((kind == "view") & (k % 3 == 0), k % 5).cast("bigint").alias("num_running_funcs"),
        F.when(kind == "view", F.col("value")).alias("gpu_est_total"),
        F.when(kind == "purchase", F.col("value")).alias("e2etime"),
        F.when(kind == "purchase", F.when(k % 4 == 0, "CPU").otherwise(vocab.GPU)).alias("compute"),
    )
