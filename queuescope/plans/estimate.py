"""Errors of the platform's own latency estimate."""

from pyspark.sql import DataFrame

from queuescope.operators.errors import ERRORS, invocation_rollup, with_errors


def current_estimate_errors(events: DataFrame) -> DataFrame:
    """One row per GPU request: latency, estimate and the three errors. One shuffle."""
    gpu = invocation_rollup(events).filter("is_gpu")
    scored = with_errors(gpu, "e2etime", "gpu_est_total")
    return scored.select("session_id", "fqdn", "tid", "e2etime", "gpu_est_total", *ERRORS)
