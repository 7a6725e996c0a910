"""Registered queries against DuckDB on the smallest test data."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()

#: Queries that fit, store, number sessions or look up bounds; the others only count rows before they run.
WITH_JOBS = {
    "features_lagged_time", "features_lagged_range", "describe_ranked", "histogram", "histogram_log",
    "baseline_fit", "grid_search", "feature_importance", "scored_results", "batch_score",
    "stump_results", "stump_metrics", "estimator_comparison", "table_round_trip", "fold_assignment",
    "stream_replay", "stream_target_queue", "quantiles_merged",
    "grid_closed_form", "forest_cells", "importance_cells",
    "stored_sessions", "stored_chosen", "rejected_lines", "accepted_events", "line_counts", "catalog_extended",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, (bool, str)):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value) + 0.0) if abs(value) < 2**53 else repr(value)
    return str(value)


def of_the_library(names):
    """Without the text-preparation queries, which have tests of their own."""
    return {n for n in names if n != "pipeline" and not re.match(r"op\d+_", n)}


def test_every_query_has_sql():
    assert of_the_library(QUERIES) == of_the_library(ORACLES)
    assert set(ORACLES) <= set(QUERIES)


def test_building_a_plan_starts_no_job_beyond_counting_rows(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans")
    try:
        for name in sorted(of_the_library(QUERIES) - WITH_JOBS):
            before = len(tracker.getJobIdsForGroup("building"))
            QUERIES[name](spark, DATA)
            # Each reader looks up file schemas and counts rows (from the file footers) or rows per key.
            started = len(tracker.getJobIdsForGroup("building")) - before
            assert started <= 8, (name, started)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    wanted = sorted(
        tuple(plain(v) for _, v in sorted(zip(columns, row), key=lambda p: p[0]))
        for row in found.fetchall()
    )
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == wanted
    assert got


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
