"""Forest model on the feature table of the smallest test data."""

import math

import pytest
from pyspark.sql import functions as F

from queuescope import vocab
from queuescope.operators import grown
from queuescope.operators import model as M
from queuescope.plans.training import tune, with_policy_features, write_tuned
from queuescope.registry import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """Arrivals with a latency that depends on the cold-start flag and the queue."""
    features = queries._features(spark, DATA, [1], profile=False)
    latency = 1.0 + 8.0 * F.col("is_cold_start") + 0.3 * F.col("others_len_queue")
    return features.withColumn("e2etime", latency).cache()


def test_feature_names(rows):
    names = M.feature_names(rows.withColumn("flag", F.lit(1)))
    assert names[: len(vocab.BASE_FEATURES)] == vocab.BASE_FEATURES
    assert "flag" not in names and "target_queue_len_lag_1" in names
    with pytest.raises(ValueError, match="is_cold_start"):
        M.feature_names(rows.drop("is_cold_start"))


def test_rows_without_missing_values(rows):
    holes = rows.withColumn("iat", F.when(F.col("session_id") != 1, F.col("iat")))
    kept = M.model_rows(holes)
    assert kept.count() == rows.filter("session_id != 1").count()
    r = kept.first()
    assert r.log_latency == pytest.approx(math.log1p(r.e2etime))


def test_splits(rows):
    split = M.session_split(rows, [5, 6])
    assert {r[0] for r in split.filter("is_test").select("session_id").collect()} <= {5, 6}
    assert {r[0] for r in split.filter("not is_test").select("session_id").collect()}.isdisjoint({5, 6})
    with pytest.raises(ValueError):
        M.session_split(rows, None)
    with pytest.raises(ValueError):
        M.session_split(rows, [1], session="absent")
    a = M.random_split(rows).filter("is_test").select("session_id", "tid").collect()
    b = M.random_split(rows.repartition(3)).filter("is_test").select("session_id", "tid").collect()
    assert set(a) == set(b) and 0 < len(a) < rows.count() / 2


def test_tuning(rows, spark, tmp_path):
    grid = {"numTrees": [5], "maxDepth": [2, 6], "minInstancesPerNode": [2]}
    tuned = tune(rows, test_sessions=[5, 6], by_session=True, grid=grid)
    assert len(tuned.scores) == 2 and all(s["mse"] >= 0 for s in tuned.scores)
    assert sum(w for _, w in tuned.importance) == pytest.approx(1.0)
    assert tuned.importance[0][0] == "is_cold_start"
    metrics = {r.is_test: r for r in tuned.metrics.collect()}
    assert metrics[False].r2_log > 0.5
    results = tuned.results
    assert results.count() == rows.count()
    actual = [r.e2etime for r in rows.select("e2etime").collect()]
    mean = sum(actual) / len(actual)
    mean_error = sum(abs(a - mean) for a in actual) / len(actual)
    assert results.agg(F.avg("absolute_error")).first()[0] < mean_error

    path = str(tmp_path / "model")
    M.save_model(tuned.model, path)
    again = M.predict(M.load_model(path), rows).select("tid", "session_id", "rf_prediction")
    before = M.predict(tuned.model, rows).select("tid", "session_id", "rf_prediction")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, before.collect()))


@pytest.mark.parametrize("sessions", [3, 1000, 1001])
def test_folds_are_whole_sessions_and_stay(spark, sessions):
    table = spark.range(sessions * 2).selectExpr("id div 2 as session_id", "cast(id as string) as tid")
    folds = {}
    for r in M.with_folds(table, 3).collect():
        assert folds.setdefault(r.session_id, r.fold) == r.fold
    assert folds == {s: s % 3 for s in range(sessions)}


def test_too_few_sessions_for_folds(spark):
    table = spark.range(40).selectExpr("id % 2 as session_id", "cast(id as string) as tid")
    with pytest.raises(ValueError, match="2 sessions"):
        M.with_folds(table, 3)
    by_row = M.with_folds(table, 3, fold_by="row").collect()
    assert len(by_row) == 40 and {r.fold for r in by_row} == {0, 1, 2}
    with pytest.raises(ValueError, match="fold_by"):
        M.with_folds(table, 3, fold_by="tree")


def test_every_row_is_scored(rows):
    train = M.model_rows(rows)
    model = M.fit_forest(train, ["is_cold_start", "iat"], numTrees=1, maxDepth=2)
    holes = rows.withColumn("iat", F.when(F.col("session_id") != 1, F.col("iat")))
    got = M.predict(model, holes).collect()
    assert len(got) == rows.count()
    assert all((r.rf_prediction is None) == (r.session_id == 1) for r in got)
    assert all((r.predicted_log is None) == (r.session_id == 1) for r in got)


def test_policy_features_can_be_tuned(rows, tmp_path):
    labelled, base = with_policy_features(rows)
    grid = {"numTrees": [2], "maxDepth": [2]}
    tuned = tune(labelled, test_sessions=[5, 6], by_session=True, grid=grid, base=base)
    assert {name for name, _ in tuned.importance} == {*base, *[c for c in rows.columns if "_lag_" in c]}
    assert {r.is_test for r in tuned.baseline_metrics.collect()} == {True, False}
    write_tuned(tuned, str(tmp_path / "job"))
    spark = rows.sparkSession
    stored = spark.read.parquet(str(tmp_path / "job" / "results"))
    assert stored.count() == tuned.results.count()
    csv = spark.read.option("header", "true").csv(str(tmp_path / "job" / "results_csv"))
    assert csv.count() == stored.count()
    assert spark.read.parquet(str(tmp_path / "job" / "metrics")).count() == 4
    assert M.load_model(str(tmp_path / "job" / "model")).stages[0].getInputCols() == M.feature_names(labelled, base)


def test_metrics_of_a_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    (r,) = M.model_metrics(df, "y", "p").collect()
    assert r.r2_log is None and r.n == 2


def test_a_fit_has_a_task_per_core_however_many_partitions_its_rows_have(spark, monkeypatch):
    seen, fit = [], M.Pipeline.fit

    def spied(self, dataset, params=None):
        seen.append((dataset.rdd.getNumPartitions(), self.getStages()[-1].getCacheNodeIds()))
        return fit(self, dataset, params)

    monkeypatch.setattr(M.Pipeline, "fit", spied)
    cores = spark.sparkContext.defaultParallelism
    value = F.when(F.col("id") % 2 == 0, 1.0).otherwise(3.0)
    rows = spark.range(0, 400, 1, 5 * cores).select((F.col("id") % 2).alias("flag"), value.alias(M.LABEL), "id")
    model = M.fit_forest(rows, ["flag"], numTrees=1, maxDepth=2, bootstrap=False)
    assert seen == [(cores, True)]
    scored = M.predict(model, rows)
    assert scored.filter(F.col("predicted_log") == F.col(M.LABEL)).count() == 400
    assert [M.fit_parts(n, 12) for n in (0, 12 * M.FIT_ROWS, 12 * M.FIT_ROWS + 1)] == [12, 12, 13]


def test_the_baseline_is_grown_in_tasks_where_rows_fit_one(rows, monkeypatch):
    train, names, seen, fit = M.model_rows(rows).cache(), M.feature_names(rows), [], grown.RandomForestRegressor.fit
    monkeypatch.setattr(grown.RandomForestRegressor, "fit", lambda self, known: seen.append(known.count()) or fit(self, known))
    error = F.avg((F.col("predicted_log") - F.col(M.LABEL)) ** 2)
    model = M.baseline_forest(train, names)
    own = M.predict(model, train).agg(error).first()[0]
    assert seen == [1]  # the form of a stored forest
    assert model.stages[-1].getNumTrees == vocab.BASELINE_TREES and model.stages[0].getInputCols() == names
    assert own < 0.1 * train.agg(F.var_pop(M.LABEL)).first()[0]
    monkeypatch.setattr(grown, "TASK_BYTES", 0)
    by_spark = M.predict(M.baseline_forest(train, names), train).agg(error).first()[0]
    assert by_spark == pytest.approx(own, rel=0.5)


def test_no_forest_is_grown_on_unknown_features_or_no_rows(rows):
    train = M.model_rows(rows)
    with pytest.raises(ValueError, match="no rows"):
        M.baseline_forest(train.filter("tid is null"), ["iat"])
    with pytest.raises(ValueError, match="features"):
        M.baseline_forest(train.withColumn("iat", F.when(F.col("session_id") != 1, F.col("iat"))), ["iat"])
