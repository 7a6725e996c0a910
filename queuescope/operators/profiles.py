"""Function profiles: mean warm and cold execution time per base function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.functions.fields import base_function


def profile_means(documents: DataFrame) -> DataFrame:
    """Mean sample per base function from parsed profile documents (column ``data``).

    A missing or empty sample list gives 0.0. A sample that is no number, in either list of an entry,
    makes both means of the base function 0.0. Samples are summed inside each list, so documents are
    never blown up to one row per sample.
    """
    # Not ``explode``: Spark would look for empty maps below it, and parse each text once more for that.
    entry = documents.select(F.explode_outer("data").alias("base_function", "info")).filter("base_function is not null")
    gpu = F.col("info.resource_data.gpu")
    nothing = F.array().cast("array<double>")
    names = ["warm_results_sec", "cold_results_sec"]
    lists = entry.select(
        "base_function",
        *[
            F.coalesce(F.transform(gpu[n], lambda x: x.try_cast("double")), nothing).alias(n)
            for n in names
        ],
    )
    bad = F.max(
        F.exists(names[0], lambda x: x.isNull()) | F.exists(names[1], lambda x: x.isNull())
    )

    def mean_of(samples):
        total = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
        mean = F.sum(total) / F.nullif(F.sum(F.size(samples)), F.lit(0))
        return F.when(bad, F.lit(0.0)).otherwise(F.coalesce(mean, F.lit(0.0)))

    return lists.groupBy("base_function").agg(
        *[mean_of(n).alias(f"gpu_{n}") for n in names]
    )


def join_profile(requests: DataFrame, profile: DataFrame | None) -> DataFrame:
    """Add base function and its profile; 0.0 where the profile (or its entry) is missing."""
    named = requests.withColumn("base_function", base_function(F.col("fqdn")))
    values = ["gpu_warm_results_sec", "gpu_cold_results_sec"]
    if profile is None:
        return named.withColumns({v: F.lit(0.0) for v in values})
    joined = named.join(profile, "base_function", "left")
    return joined.select(
        *named.columns, *[F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in values]
    )
