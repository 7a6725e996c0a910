"""Tables behind exploratory charts: sizes, means, quantiles, histograms, boxes, correlations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuescope.operators import sketches
from queuescope.operators.scan import RunningSum, ScanPlan
from queuescope.session import cut_lineage

# Quartiles of a five-number summary, and the whisker length of a box in IQRs.
QUARTILES = (0.25, 0.5, 0.75)
WHISKER = 1.5


def without_sessions(df: DataFrame, sessions: Iterable[int], after: int | None = None) -> DataFrame:
    """Drop the named sessions; with ``after`` keep only those of a higher number."""
    kept = df.filter(~F.col("session_id").isin(list(sessions)))
    return kept if after is None else kept.filter(F.col("session_id") > after)


def session_sizes(df: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Smallest, largest and mean number of rows per session, and the number of sessions."""
    sizes = df.groupBy(*keys).count()
    return sizes.agg(
        F.min("count").alias("min_rows"),
        F.max("count").alias("max_rows"),
        F.avg("count").alias("mean_rows"),
        F.count(F.lit(1)).alias("sessions"),
    )


def session_means(df: DataFrame, value: str, key: str = "session_id") -> DataFrame:
    """Mean per session, in session order."""
    return df.groupBy(key).agg(F.avg(value).alias("mean_value")).orderBy(key)


def grand_mean(means: DataFrame) -> DataFrame:
    """Mean of the session means."""
    return means.agg(F.avg("mean_value").alias("grand_mean"))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    plan: ScanPlan | None = None,
    error: float | None = None,
) -> DataFrame:
    """Quantiles per key as array ``quantiles``, and count ``n``.

    Exact, with linear interpolation, unless ``error`` says how far a rank may be off as a share of
    the group's rows; then they are values of the group, found by sketches of bounded size.

    ``percentile`` holds all distinct values of a group in one task, so it serves small groups
    only. Otherwise equal values are counted first and the counts are stored; all else comes from
    them: running counts over the sorted distinct values give ranks, and the values at the wanted
    ranks are picked by an aggregate.
    """
    if error is not None:
        return sketches.sketch_quantiles(sketches.quantile_sketches(df, keys, value, error), keys, probabilities)
    known = _known(df, keys, value)
    plan = plan or ScanPlan.measure(known, keys)
    if plan.is_whole:
        return known.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), _percentile(probabilities).alias("quantiles")
        )
    picked = _ranked(known, keys).groupBy(*keys, "n").agg(*_picks(probabilities))
    return picked.select(*keys, "n", _interpolated(probabilities).alias("quantiles"))


def _known(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    known = df.select(*keys, F.col(value).cast("double").alias("__value"))
    return known.filter("__value is not null")


def _percentile(probabilities: Sequence[float]) -> Column:
    return F.percentile("__value", F.array(*[F.lit(float(p)) for p in probabilities]))


def _ranked(known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct values with ``__count`` and running count ``__through``; rows ``n`` and ``__mean`` of the key."""
    counted = cut_lineage(known.groupBy(*keys, "__value").agg(F.count(F.lit(1)).alias("__count")))
    ranked = ScanPlan.measure(counted, keys).compute(
        counted, keys, ["__value"], __through=RunningSum(F.col("__count"))
    )
    total, n = F.sum(F.col("__value") * F.col("__count")), F.sum("__count")
    sizes = counted.groupBy(*keys).agg(n.alias("n"), (total / n).alias("__mean"))
    if keys:
        return ranked.join(sizes, list(keys))
    one = sizes.first()
    return ranked.withColumns({c: F.lit(one[c]) for c in sizes.columns})


def _place(probability: float) -> Column:
    return (F.col("n") - 1) * F.lit(float(probability))


def _picks(probabilities: Sequence[float]) -> list[Column]:
    """The values at the ranks below and above each quantile."""

    def at(rank: Column) -> Column:
        # The first distinct value whose running count passes the 0-based rank.
        return F.min(F.when(F.col("__through") > rank, F.col("__value")))

    picks = []
    for i, p in enumerate(probabilities):
        picks += [at(F.floor(_place(p))).alias(f"__lo_{i}"), at(F.ceil(_place(p))).alias(f"__hi_{i}")]
    return picks


def _interpolated(probabilities: Sequence[float]) -> Column:
    out = []
    for i, p in enumerate(probabilities):
        part = _place(p) - F.floor(_place(p))
        low, high = F.col(f"__lo_{i}"), F.col(f"__hi_{i}")
        out.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high))
    return F.array(*out)


def describe(
    df: DataFrame, value: str, plan: ScanPlan | None = None, error: float | None = None
) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum; one row from one aggregate.

    With ``error`` the quartiles come from a sketch whose ranks may be off by that share of the rows.
    """
    ends = [F.min("__value").alias("min"), F.max("__value").alias("max")]
    if error is not None:
        return _sketched(sketches.numbers(df, [], value), ends, error)
    known = _known(df, [], value)
    plan = plan or ScanPlan.measure(known)
    if plan.is_whole:
        row = known.agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("__value").alias("mean"),
            F.stddev_samp("__value").alias("std"),
            *ends,
            _percentile(QUARTILES).alias("__quartiles"),
        )
    else:
        off = F.col("__value") - F.col("__mean")
        spread = F.sum(off * off * F.col("__count"))
        row = _ranked(known, []).groupBy(F.col("n"), F.col("__mean").alias("mean")).agg(
            F.sqrt(F.try_divide(spread, F.max("n") - 1)).alias("std"), *ends, *_picks(QUARTILES)
        )
        row = row.select("*", F.col("n").alias("count"), _interpolated(QUARTILES).alias("__quartiles"))
    quarters = [F.col("__quartiles")[i].alias(c) for i, c in enumerate(["q25", "q50", "q75"])]
    return row.select("count", "mean", "std", "min", *quarters, "max")


def _sketched(known: DataFrame, ends: Sequence[Column], error: float) -> DataFrame:
    row = known.agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("__value").alias("mean"),
        F.stddev_samp("__value").alias("std"),
        *ends,
        sketches.sketch_of(F.col("__value"), error).alias("__sketch"),
    )
    quarters = [
        F.when(F.col("count") > 0, sketches.estimate(F.col("__sketch"), p, F.col("min"), F.col("max"))).alias(c)
        for p, c in zip(QUARTILES, ["q25", "q50", "q75"], strict=True)
    ]
    return row.select("count", "mean", "std", "min", *quarters, "max")


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin includes its upper edge.

    The two bounds come back to the driver as one row; counting is one partial aggregate. If all
    values are equal the bins span half a unit to each side.
    """
    bounds = df.agg(
        F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")
    ).first()
    spark = df.sparkSession
    numbers = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if bounds.lo is None:
        lo, width = 0.0, 1.0 / bins
    elif bounds.lo == bounds.hi:
        lo, width = bounds.lo - 0.5, 1.0 / bins
    else:
        lo, width = bounds.lo, (bounds.hi - bounds.lo) / bins
    number = bin_number(F.col(value).cast("double"), lo, width, bins)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edge = F.col("bin") * F.lit(width) + F.lit(lo)
    upper = (F.col("bin") + 1) * F.lit(width) + F.lit(lo)
    return numbers.join(F.broadcast(counts), "bin", "left").select(
        "bin", edge.alias("lower"), upper.alias("upper"), F.coalesce("n", F.lit(0)).alias("n")
    )


def bin_number(value: Column, lo: float, width: float, bins: int) -> Column:
    """Bin of ``value``; a value that rounding put beside its edges is moved to the right bin."""
    guess = F.least(F.floor((value - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    low = (value < guess * F.lit(width) + F.lit(lo)).cast("int")
    high = ((value >= (guess + 1) * F.lit(width) + F.lit(lo)) & (guess < bins - 1)).cast("int")
    return (guess - low + high).cast("int")


def box_summary(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    plan: ScanPlan | None = None,
    error: float | None = None,
) -> DataFrame:
    """Quartiles, whisker ends (furthest values within 1.5 IQR) and outlier count per key.

    With ``error`` the quartiles are those of a sketch (see ``quantiles``); whiskers and outliers are
    exact for these quartiles.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__x"))
    quarters = quantiles(known, keys, "__x", QUARTILES, plan, error).select(
        *keys, "n", *[F.col("quantiles")[i].alias(c) for i, c in enumerate(["q25", "q50", "q75"])]
    )
    reach = (F.col("q75") - F.col("q25")) * F.lit(WHISKER)
    inside = F.col("__x").between(F.col("q25") - reach, F.col("q75") + reach)
    joined = known.join(quarters, list(keys))
    return joined.groupBy(*keys, "n", "q25", "q50", "q75").agg(
        F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
        F.sum((~inside).cast("int")).alias("outliers"),
    )


def top_keys(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent keys; ties by key."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), key).limit(k)


def topk_subset(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """All rows of the ``k`` most frequent keys."""
    return df.join(F.broadcast(top_keys(df, key, k).select(key)), key, "left_semi")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value, most frequent first; NULL is not counted."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column)


def correlation(
    df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = ()
) -> DataFrame:
    """Pearson correlation of each pair, overall or per key, as ``corr_<left>_<right>``."""
    return df.groupBy(*keys).agg(
        *[F.corr(a, b).alias(f"corr_{a}_{b}") for a, b in pairs]
    )


def session_series(
    df: DataFrame, session: int, columns: Sequence[str], time: str, seq: str
) -> DataFrame:
    """Chosen columns of one session in time order; ``sketches.reduced_series`` thins a long one out."""
    return df.filter(F.col("session_id") == session).select(*columns).orderBy(time, seq)


def distinct_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def union_sessions(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; a column a table lacks is NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
