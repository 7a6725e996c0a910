"""Stored tables: Parquet between steps, CSV for export."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = ()
) -> None:
    """Parquet, one folder per value of ``partition_by``, rows gathered by ``cluster_by``.

    Folders suit columns of few values (a policy). Sessions may be many, so they are clustered:
    rows of a session lie together, and a filter on it skips row groups by their bounds. Adaptive
    execution merges small groups into one file and splits a hot one over several.
    """
    keys = [*partition_by, *cluster_by]
    if keys:
        df = df.hint("rebalance", *keys).sortWithinPartitions(*keys)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stored table. With its ``schema`` no file is opened before the rows are asked for."""
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def read_sessions(
    spark: SparkSession,
    path: str,
    policies: Iterable[str] | None = None,
    sessions: Iterable[int] | None = None,
    without: Iterable[int] = (),
    schema=None,
) -> DataFrame:
    """Rows of some policies and sessions of a table that is stored by policy and clustered by session.

    Folders of other policies are not listed as input, and row groups whose bounds hold none of the
    sessions are skipped, because the conditions are on the stored columns themselves. ``without``
    leaves sessions out; that skips nothing, since a row group holds its neighbours as well.
    """
    rows = read_table(spark, path, schema)
    if policies is not None:
        rows = rows.filter(F.col("policy").isin(list(policies)))
    if sessions is not None:
        wanted = sorted(set(sessions))
        if not wanted:
            return rows.filter(F.lit(False))
        # The span is what a row group's bounds are held against, however many sessions there are.
        rows = rows.filter(F.col("session_id").between(wanted[0], wanted[-1]) & F.col("session_id").isin(wanted))
    for session in without:
        rows = rows.filter(F.col("session_id") != session)
    return rows


def read_chosen(spark: SparkSession, path: str, chosen: DataFrame, schema=None) -> DataFrame:
    """Rows of the policies and sessions in ``chosen`` (policy, session_id), another query's result.

    The policies that ``chosen`` turns out to have decide at run time which folders are read, if it is
    small enough to be broadcast; without that the join is the same but reads all of them.
    """
    keys = chosen.select("policy", "session_id").distinct()
    return read_table(spark, path, schema).join(keys, ["policy", "session_id"], "left_semi")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a given schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", "true").csv(path)
