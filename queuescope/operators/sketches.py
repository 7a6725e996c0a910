"""Quantiles from mergeable sketches, and point samples, for groups of any size.

A sketch is made by a partial aggregate: each task sends one of bounded size per key, and no group's
values travel. Sketches can be stored and merged later, so the quantiles of a union need no second
pass over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest and smallest size parameter of a KLL sketch.
_SIZES = (8, 65_535)


def sketch_size(error: float) -> int:
    """The size parameter whose usual rank error is half of ``error``.

    The published rank error of a KLL sketch of size k is 2.296 / k ** 0.9021, kept in 99 of 100 cases.
    With half of it to spare a rank lies outside about once in millions of sketches.
    """
    if not 0 < error < 1:
        raise ValueError("the rank error is a share between 0 and 1")
    size = math.ceil((2 * 2.296 / error) ** (1 / 0.9021))
    if size > _SIZES[1]:
        raise ValueError(f"a sketch cannot keep ranks to {error}")
    return max(_SIZES[0], size)


def numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The keys and ``__value``, without NULL and NaN."""
    known = df.select(*keys, F.col(value).cast("double").alias("__value"))
    return known.filter("__value is not null and not isnan(__value)")


def sketch_of(value: Column, error: float) -> Column:
    return F.kll_sketch_agg_double(value, F.lit(sketch_size(error)))


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, error: float) -> DataFrame:
    """Per key ``n``, ``min``, ``max`` and a ``sketch`` whose ranks are right within ``error * n``.

    NULL and NaN do not count; a key without other values has no row.
    """
    found = numbers(df, keys, value).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("__value").alias("min"),
        F.max("__value").alias("max"),
        sketch_of(F.col("__value"), error).alias("sketch"),
    )
    return found.filter("n > 0")


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of finer groups as those of ``keys``."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    ).filter("n > 0")


def estimate(sketch: Column, probability: float, low: Column, high: Column) -> Column:
    """A value whose rank is about the probability; the ends are exact."""
    if probability <= 0:
        return low
    if probability >= 1:
        return high
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(probability)))


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Per key ``n`` and the array ``quantiles``; each is one of the group's values."""
    found = [estimate(F.col("sketch"), p, F.col("min"), F.col("max")) for p in probabilities]
    return sketches.select(*keys, "n", F.array(*found).alias("quantiles"))


def rank_gaps(
    df: DataFrame, keys: Sequence[str], value: str, found: DataFrame, probabilities: Sequence[float]
) -> DataFrame:
    """How far ``found`` quantiles are from their ranks, per key as array ``gaps`` of shares of ``n``.

    A value of the group stands for all ranks from the rows below it to those up to it; the gap is 0
    if the wanted rank is one of them. One join of the rows with one row per key, and sums.
    """
    rows = numbers(df, keys, value).join(found, list(keys))
    at = [F.col("quantiles")[i] for i in range(len(probabilities))]
    counted = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum((F.col("__value") < q).cast("bigint")).alias(f"__below_{i}") for i, q in enumerate(at)],
        *[F.sum((F.col("__value") <= q).cast("bigint")).alias(f"__upto_{i}") for i, q in enumerate(at)],
    )
    gaps = []
    for i, p in enumerate(probabilities):
        low, high = (F.col(f"{c}_{i}") / F.col("rows") for c in ("__below", "__upto"))
        gaps.append(F.greatest(low - F.lit(float(p)), F.lit(float(p)) - high, F.lit(0.0)))
    return counted.select(*keys, "rows", F.array(*gaps).alias("gaps"))


# --- Fewer points, for export -------------------------------------------------------------------


def reduced_series(
    df: DataFrame,
    value: str,
    points: int,
    keys: Sequence[str] = ("session_id",),
    time: str = "ts_ns",
    seq: str = "seq",
) -> DataFrame:
    """At most ``points`` rows per key that draw the same line: the time span is cut into equal parts,
    and the first, last, lowest and highest row of each stay.

    Both steps are partial aggregates: the span of each key, and up to four rows per key and part. Of
    equal values the earliest row stays. Rows without a key, a time or a value are left out.
    """
    parts = max(1, points // 4)
    known = df.filter(F.col(time).isNotNull() & F.col(value).isNotNull())
    spans = known.groupBy(*keys).agg(F.min(time).alias("__from"), F.max(time).alias("__to"))
    rest = [c for c in df.columns if c not in keys]
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    number = F.call_function("div", (wide(time) - wide("__from")) * parts, wide("__to") - wide("__from") + 1)
    placed = known.join(spans, list(keys)).withColumn("__part", number)
    row = F.struct(*[F.col(c) for c in rest])
    order = [F.col(time), F.col(seq)]
    falling = [-F.col(time), -F.col(seq)]
    kept = placed.groupBy(*keys, "__part").agg(
        F.min_by(row, F.struct(*order)).alias("a"),
        F.max_by(row, F.struct(*order)).alias("b"),
        F.min_by(row, F.struct(F.col(value), *order)).alias("c"),
        F.max_by(row, F.struct(F.col(value), *falling)).alias("d"),
    )
    some = kept.select(*keys, F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("__row"))
    return some.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def sampled_points(df: DataFrame, points: int, identity: Sequence[str], keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """The ``points`` rows of each key whose identity has the smallest digest; ties by identity.

    The same rows whatever the partitions, and a sample of two tables together is the sample of their
    samples. Each task keeps ``points`` rows per key before anything is shuffled. NULL in the identity
    counts as a value of its own.
    """
    text = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in identity]
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(",", *text)), *identity)
    return df.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= points).drop("__rank")
