"""Lagged state: what the system looked like some arrivals earlier."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queuescope.operators.scan import Lag, ScanPlan


def add_lag_probes(rows: DataFrame, lags: Iterable[int], narrow: Iterable[str]) -> DataFrame:
    """For each arrival add one probe row per lag, placed at the time of that earlier arrival.

    The probe keeps the queue of *this* arrival, so reading the queue state there answers "how long
    was my queue ``lag`` arrivals ago". Probes carry only the ``narrow`` columns. The row itself has
    ``lag_no`` 0 and ``probe_ns`` = its own time.
    """
    own = F.struct(F.lit(0).alias("lag_no"), F.col("ts_ns").alias("probe_ns"))
    back = [
        F.when(
            F.col("is_gpu_arrival") & F.col(f"time_lag_{k}").isNotNull(),
            F.struct(F.lit(k).alias("lag_no"), F.col(f"time_lag_{k}").alias("probe_ns")),
        )
        for k in lags
    ]
    probes = F.filter(F.array(own, *back), lambda p: p.isNotNull())
    narrow = set(narrow)
    spread = rows.select("*", F.explode(probes).alias("__probe"))
    is_own = F.col("__probe.lag_no") == 0
    return spread.select(
        *[
            c if c in narrow else F.when(is_own, F.col(c)).alias(c)
            for c in rows.columns
            if not c.startswith("time_lag_")
        ],
        "__probe.lag_no",
        "__probe.probe_ns",
    )


def fold_lag_probes(rows: DataFrame, lags: Iterable[int], plan: ScanPlan | None = None) -> DataFrame:
    """Bring the lengths read by probes back to their arrival, as ``target_queue_len_lag_<k>``.

    Groups are one arrival and its probes, a handful of rows. No earlier arrival means 0.
    """
    group = ["session_id", "kind", "seq"]
    window = Window.partitionBy(*group)
    rows = plan.spread(rows, group) if plan else rows
    read = {
        f"target_queue_len_lag_{k}": F.coalesce(
            F.max(F.when(F.col("lag_no") == k, F.col("len"))).over(window), F.lit(0)
        )
        for k in lags
    }
    return rows.withColumns(read).filter("lag_no = 0")


def with_global_lags(arrivals: DataFrame, plan: ScanPlan, lags: Iterable[int]) -> DataFrame:
    """Lagged total length without the lagged own queue, and lagged running count; 0 if none."""
    lags = list(lags)
    if not lags:
        return arrivals
    values = {"__total": F.col("total"), "__running": F.col("num_running_funcs_filled")}
    shifted = plan.compute(
        arrivals, ["session_id"], ["ts_ns", "seq"], "ts_ns", back=Lag(values, lags)
    )
    out = list(arrivals.columns)
    for k in lags:
        total = F.coalesce(F.col(f"__total_lag_{k}"), F.lit(0))
        out.append(
            (total - F.col(f"target_queue_len_lag_{k}")).alias(f"others_len_queue_lag_{k}")
        )
        out.append(
            F.coalesce(F.col(f"__running_lag_{k}"), F.lit(0)).alias(
                f"num_running_funcs_filled_lag_{k}"
            )
        )
    return shifted.select(*out)
