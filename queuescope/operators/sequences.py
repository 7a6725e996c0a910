"""Session sequences: the ordered arrivals of a session as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.operators.scan import ScanPlan, position


def session_sequences(
    arrivals: DataFrame,
    columns: Sequence[str],
    plan: ScanPlan | None = None,
    time: str = "invocation_ts_ns",
    seq: str = "seq",
    *,
    part_rows: int,
) -> DataFrame:
    """Unpadded, ordered sequences, one row per session and ``part``.

    A session of up to ``part_rows`` arrivals is one row (part 0). A longer one continues in further
    parts; nothing is cut off, and no array grows with the session. A consumer that carries state
    along a session starts afresh at ``part`` 0 only, and goes on over the other parts.
    """
    plan = plan or ScanPlan.measure(arrivals, ["session_id"], time)
    placed = plan.compute(arrivals, ["session_id"], [time, seq], time, __place=position())
    part = F.call_function("div", F.col("__place") - 1, F.lit(part_rows)).cast("int")
    steps = F.sort_array(F.collect_list(F.struct("__place", *columns)))
    packed = placed.groupBy("session_id", part.alias("part")).agg(
        F.count(F.lit(1)).alias("length"), steps.alias("__steps")
    )
    return packed.select(
        "session_id", "part", "length",
        F.transform("__steps", lambda s: F.struct(*[s[c].alias(c) for c in columns])).alias("steps"),
    )
