"""From a folder of worker logs to tables."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from queuescope import vocab
from queuescope.operators.profiles import profile_means
from queuescope.plans.estimate import current_estimate_errors
from queuescope.plans.features import arrival_features
from queuescope.sources import logs, tables
from queuescope.sources.profiles import read_profile


def load_events(
    spark: SparkSession, root: str, policy: str | None = None, mode: str = "FAILFAST"
) -> DataFrame:
    """Typed events of all sessions below ``root``, numbered, with policy and workload.

    Sessions are numbered from the list of files, so an empty log keeps its number, and the text is
    read once.
    """
    catalog = logs.session_catalog(logs.list_logs(spark, root, policy))
    records = logs.read_worker_logs(spark, root, policy, mode)
    return logs.typed_events(logs.number_sessions(records, catalog))


def ingest(
    spark: SparkSession, root: str, out: str, policy: str | None = None, mode: str = "FAILFAST"
) -> DataFrame:
    """Write the typed events once and go on from there.

    Text is parsed one time, later steps read the columns they need, and the row order within a
    file (``seq``) is fixed.
    """
    tables.write_table(load_events(spark, root, policy, mode), out, ["policy"], ["session_id"])
    return tables.read_table(spark, out)


@dataclass
class Sorted:
    """Lines of logs after one scan: events, rejected lines, and how many there are of each kind."""

    events: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def sort_lines(lines: DataFrame, out: str, text: str = "line") -> Sorted:
    """Typed events and rejected lines from one pass over JSON lines, stored together below ``out``.

    The lines are parsed once and written once, into a folder for the events and one for each reason of
    rejection; both results read their own folders only. Every count is taken while the lines are
    written. No event has NULL in all fields because its line could not be read.
    """
    judged = logs.judged_lines(lines, text)
    seen = Observation("lines")
    counted = judged.observe(
        seen,
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("reason").isNull()).alias("events"),
        F.count_if(F.col("reason") == logs.NOT_JSON).alias("not_json"),
        F.count_if(F.col("reason") == logs.NO_TIME).alias("no_time"),
    )
    typed = logs.typed_events(counted, keep=("reason", text, "path"))
    typed.write.mode("overwrite").partitionBy("reason").parquet(out)
    stored = lines.sparkSession.read.schema(typed.schema).parquet(out)
    own = [c for c in ("session_id", "session_key", "path") if c in stored.columns]
    return Sorted(
        events=stored.filter("reason is null").drop("reason", text, "path"),
        rejected=stored.filter("reason is not null").select(*own, "seq", "reason", text),
        counts=seen.get,
    )


def ingest_lenient(
    spark: SparkSession, root: str, out: str, policy: str | None = None, catalog: str | None = None
) -> Sorted:
    """Like ``ingest``, but lines that are no events go to a table of their own, with file and order.

    Sessions are numbered by the catalog stored at ``catalog`` (by default below ``out``), which is
    extended by the logs that are not in it; known sessions keep their numbers. A log without a line
    gets its number when it has one.
    """
    lines = logs.read_log_lines(spark, root, policy)
    known = logs.update_catalog(spark, catalog or posixpath.join(out, "catalog"), logs.logs_of(lines))
    return sort_lines(logs.number_sessions(lines, known), posixpath.join(out, "lines"))


def write_estimate_errors(events: DataFrame, out: str) -> None:
    tables.write_table(current_estimate_errors(events), out, cluster_by=["session_id"])


def write_features(
    events: DataFrame,
    out: str,
    profile_path: str | None = None,
    lags: Iterable[int] = vocab.DEFAULT_LAGS,
    causal: bool = False,
) -> None:
    """Feature table, one folder per policy, clustered by session."""
    documents = read_profile(events.sparkSession, profile_path) if profile_path else None
    profile = None if documents is None else profile_means(documents)
    features = arrival_features(events, profile, lags, causal=causal)
    tables.write_table(features, out, ["policy"], ["session_id"])
