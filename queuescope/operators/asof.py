"""As-of lookup: the latest known state at or before a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.operators.scan import LastKnown, ScanPlan


def asof_lookup(
    probes: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    time: str,
    values: dict[str, object],
    state_order: str,
    plan: ScanPlan | None = None,
) -> DataFrame:
    """Add to each probe the last non-NULL ``values`` of its key at ``time`` or earlier.

    ``values`` maps state columns to what a probe without earlier state gets. States at exactly the
    probe's time count; among states of equal time the one with the largest ``state_order`` wins.
    One shuffle on ``keys``: both sides are stacked in time order and values are carried forward.
    The order of probes of equal time does not matter; a hash of their columns gives them distinct
    places, so that very many of them can still be cut into ranges.
    """
    kept = probes.columns
    stacked = probes.select(
        *keys,
        time,
        F.lit(1).alias("__kind"),
        F.xxhash64(*kept).alias("__tie"),
        F.struct(*kept).alias("__probe"),
    ).unionByName(
        states.select(
            *keys, time, F.lit(0).alias("__kind"), F.col(state_order).cast("bigint").alias("__tie"), *values
        ),
        allowMissingColumns=True,
    )
    if plan is None:
        plan = ScanPlan.measure(stacked, keys, time)
    carried = plan.compute(
        stacked,
        keys,
        [time, "__kind", "__tie"],
        time,
        **{f"__v_{name}": LastKnown(F.col(name)) for name in values},
    )
    return carried.filter("__kind = 1").select(
        *[F.col("__probe")[c].alias(c) for c in kept],
        *[
            F.coalesce(F.col(f"__v_{name}"), F.lit(default)).alias(name)
            for name, default in values.items()
        ],
    )


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that is last in ``order``.

    An aggregate, so each task first reduces its own rows and a hot key does not travel whole.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    )
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
