"""Errors of latency estimates: per request, per function, per session, and overall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.functions.fields import error_columns
from queuescope.operators.traces import TRACE

# Columns of the comparison of two estimators.
COMPARED = ["current_relative_error", "rf_model_relative_error", "improvement"]

ERRORS = ["absolute_error", "squared_error", "percentage_relative_error"]


def invocation_rollup(events: DataFrame) -> DataFrame:
    """One row per trace with estimate, latency and function, where all three are known.

    ``is_gpu`` is part of the same aggregate, so restricting to GPU traces needs no second pass.
    The largest non-NULL function name stands for the trace.
    """
    gpu = F.col("e2etime").isNotNull() & (F.col("compute") == "GPU")
    return (
        events.filter("tid is not null")
        .groupBy(*TRACE)
        .agg(
            F.max("gpu_est_total").alias("gpu_est_total"),
            F.max("e2etime").alias("e2etime"),
            F.max("fqdn").alias("fqdn"),
            F.max(F.coalesce(gpu, F.lit(False))).alias("is_gpu"),
        )
        .na.drop(subset=["gpu_est_total", "e2etime", "fqdn"])
    )


def with_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumns(error_columns(F.col(actual), F.col(predicted)))


def error_summary(
    errors: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean squared, absolute and percentage error, and the sample deviation of the error."""
    return errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("squared_error").alias("mse"),
        F.avg("absolute_error").alias("mae"),
        F.avg("percentage_relative_error").alias("mpre"),
        F.stddev_samp(F.col(predicted) - F.col(actual)).alias("std_error"),
    )


def error_by_key(
    errors: DataFrame,
    key: str,
    values: Sequence[str],
    sort: str = "absolute_error",
    ascending: bool = False,
) -> DataFrame:
    """Means per key, sorted by one of them (largest absolute error first by default)."""
    means = errors.groupBy(key).agg(*[F.avg(v).alias(v) for v in values])
    return means.orderBy(F.asc(sort) if ascending else F.desc(sort), key)


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys found on both sides."""
    return left.select(key).intersect(right.select(key))


def estimator_comparison(current: DataFrame, model: DataFrame, key: str = "fqdn") -> DataFrame:
    """Mean percentage error per function of two estimators, best improvement first.

    The inner join of the two aggregates keeps the functions both have; functions are matched by
    name, not by position.
    """
    value = "percentage_relative_error"
    before, after, gain = COMPARED
    left = current.groupBy(key).agg(F.avg(value).alias(before))
    right = model.groupBy(key).agg(F.avg(value).alias(after))
    joined = left.join(right, key).withColumn(gain, F.col(after) - F.col(before))
    return joined.orderBy(F.desc(gain), key)
