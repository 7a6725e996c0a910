"""Prefixes of forests and cut trees against fits of their own."""

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from queuescope import vocab
from queuescope.operators import forest_grid as G
from queuescope.operators import grown as W
from queuescope.operators import model as M
from queuescope.operators import trees as T


@pytest.fixture(scope="module")
def rows(spark):
    x = [F.rand(k).alias(f"x{k}") for k in range(4)]
    table = spark.range(600).select("id", (F.col("id") % 6).alias("session_id"), F.col("id").cast("string").alias("tid"), *x)
    label = 3 * F.col("x0") + F.when(F.col("x1") > 0.4, 2.0).otherwise(0.0) * F.col("x2") + 0.3 * F.rand(9)
    return table.withColumn(M.LABEL, label).coalesce(2).cache()


NAMES = [f"x{k}" for k in range(4)]
def mse(scored):
    return RegressionEvaluator(labelCol=M.LABEL, predictionCol=M.PREDICTED, metricName="mse").evaluate(scored)


def vectors(rows):
    return M.assembler(NAMES).transform(rows)


def test_a_cut_tree_is_the_tree_that_is_grown_to_that_depth(rows):
    """Without a choice of features per node there is no other draw, so the errors are equal."""
    known, unseen = vectors(rows.filter("id % 3 > 0")), vectors(rows.filter("id % 3 = 0"))
    same = {"numTrees": 6, "featureSubsetStrategy": "all", "minInstancesPerNode": 4}
    errors = G.prefix_errors(M.forest(**same, maxDepth=7).fit(known), unseen, [6], [0, 1, 2, 4, 7])
    for depth in (0, 1, 2, 4, 7):
        alone = M.forest(**same, maxDepth=depth).fit(known)
        total, n = errors[6, depth]
        assert n == 200 and total / n == pytest.approx(mse(alone.transform(unseen)), rel=1e-9)


def test_the_first_trees_are_a_smaller_forest(rows):
    known, unseen = vectors(rows.filter("id % 3 > 0")), vectors(rows.filter("id % 3 = 0"))
    model = M.forest(numTrees=5, maxDepth=3, featureSubsetStrategy="sqrt").fit(known)
    errors = G.prefix_errors(model, unseen, [1, 3, 5], [3])
    assert errors[5, 3][0] / 200 == pytest.approx(mse(model.transform(unseen)), rel=1e-9)
    one = model.trees[0].setPredictionCol(M.PREDICTED).setFeaturesCol("features")
    assert errors[1, 3][0] / 200 == pytest.approx(mse(one.transform(unseen)), rel=1e-9)


def test_search_agrees_with_separate_fits(rows):
    """Other random draws, so the errors agree within a tolerance: a fifth where only rows are drawn, and
    three tenths where a small forest also draws two of four features for each node."""
    grid = {"numTrees": [15, 30], "maxDepth": [2, 6], "minInstancesPerNode": [5, 40], "featureSubsetStrategy": ["sqrt", "all"]}
    found = G.search(rows, NAMES, grid)
    _, plain = M.grid_search(rows, NAMES, grid)
    key = lambda s: tuple(s[k] for k in grid)
    separate = {key(s): s["mse"] for s in M.grid_scores(plain)}
    assert {key(s) for s in found.scores} == set(separate) and len(found.scores) == 16
    for s in found.scores:
        tolerance = 0.2 if s["featureSubsetStrategy"] == "all" else 0.3
        assert s["mse"] == pytest.approx(separate[key(s)], rel=tolerance)
    best = min(found.scores, key=lambda s: s["mse"])
    forest = found.best.stages[-1]
    assert forest.getNumTrees == best["numTrees"] and forest.getOrDefault("maxDepth") == best["maxDepth"]
    assert separate[key(best)] <= 1.1 * min(separate.values())
    assert M.predict(found.best, rows).filter("rf_prediction is null").count() == 0


def test_full_grid_has_ninety_settings(rows, monkeypatch):
    fits = []
    monkeypatch.setattr(G, "prefix_errors", lambda m, r, trees, depths: {(t, d): (1.0, 1) for t in trees for d in depths})
    plain = M.forest
    monkeypatch.setattr(M, "forest", lambda **s: fits.append(s) or plain(numTrees=1, maxDepth=1))
    found = G.search(rows, NAMES)
    assert len(found.scores) == 90 and len(fits) == 15 * vocab.FOLDS + 1


def test_scoring_shuffles_no_row_per_tree(rows, monkeypatch):
    """The values of the leaves are looked up in the tasks, not joined to a copy of each row for each tree."""
    known, unseen = vectors(rows.filter("id % 3 > 0")), vectors(rows.filter("id % 3 = 0"))
    model = M.forest(numTrees=3, maxDepth=3).fit(known)
    monkeypatch.setattr(G.F, "posexplode", None)
    errors = G.prefix_errors(model, unseen, [3], [3])
    assert errors[3, 3][0] / errors[3, 3][1] == pytest.approx(mse(model.transform(unseen)), rel=1e-9)


def test_no_rows_to_score(rows):
    known = vectors(rows)
    model = M.forest(numTrees=2, maxDepth=2).fit(known)
    assert G.prefix_errors(model, known.filter("id < 0"), [1, 2], [2]) == {(1, 2): (0.0, 0), (2, 2): (0.0, 0)}


@pytest.fixture(scope="module")
def stepped(rows):
    """Features of few values, so that the thresholds are those between all of them."""
    steps = [F.floor(F.col(c) * k).cast("double").alias(c) for c, k in zip(NAMES, (2, 7, 20, 31))]
    return rows.select("session_id", "tid", "id", *steps, M.LABEL).coalesce(2).cache()


def coded(rows, fold="cast(session_id % 3 as int)"):
    return vectors(rows).selectExpr("features", M.LABEL, f"{fold} as __fold", "id")


@pytest.mark.parametrize("least", [1, 20])
def test_without_draws_a_forest_is_the_one_that_spark_fits(stepped, least):
    known = coded(stepped)
    plain = M.forest(numTrees=2, maxDepth=6, minInstancesPerNode=least, bootstrap=False, featureSubsetStrategy="all")
    own, spark_s = W.fitted(known, W.packed(known, plain), plain), plain.fit(known)
    a, b = ({r.id: r.prediction for r in m.transform(known).collect()} for m in (own, spark_s))
    assert a == pytest.approx(b, rel=1e-9)
    assert own.featureImportances.toArray() == pytest.approx(spark_s.featureImportances.toArray(), rel=1e-9)
    assert own.getNumTrees == 2 and own.getOrDefault("maxDepth") == 6 and own.totalNumNodes == spark_s.totalNumNodes


def test_errors_are_those_of_forests_that_spark_fits(stepped):
    """With some rows on both sides, since of two features that part few rows alike either may be taken."""
    both = coded(stepped)
    plain = M.forest(numTrees=5, maxDepth=6, minInstancesPerNode=25, bootstrap=False, featureSubsetStrategy="all")
    found = W.validated(both, W.packed(both, plain, "__fold"), [(fold, plain) for fold in range(3)], [2, 5], [0, 3, 6])
    for fold in range(3):
        model = plain.fit(both.filter(f"__fold <> {fold}"))
        wanted = G.prefix_errors(model, both.filter(f"__fold = {fold}"), [2, 5], [0, 3, 6])
        assert set(found[fold]) == set(wanted)
        for key, (total, n) in wanted.items():
            assert found[fold][key] == (pytest.approx(total, rel=1e-9), n)


def test_search_fits_no_forest_over_all_tasks_where_rows_fit_one(rows, monkeypatch):
    """45 fits of 100 trees by Spark, a level of all trees at a time, took most of the time of the full grid."""
    seen, fit = [], W.RandomForestRegressor.fit
    monkeypatch.setattr(W.RandomForestRegressor, "fit", lambda self, known: seen.append(known.count()) or fit(self, known))
    found = G.search(rows, NAMES, {"numTrees": [3], "maxDepth": [3], "featureSubsetStrategy": ["sqrt", "all"]})
    assert seen == [1] and len(found.scores) == 2  # the form of a stored forest


def test_more_rows_than_fit_a_task_are_fitted_by_spark(stepped, monkeypatch):
    grid = {"numTrees": [1, 3], "maxDepth": [0, 2, 4], "minInstancesPerNode": [1, 40]}
    own = G.search(stepped, NAMES, grid, bootstrap=False, featureSubsetStrategy="all")
    monkeypatch.setattr(W, "TASK_BYTES", 0)
    spark_s = G.search(stepped, NAMES, grid, bootstrap=False, featureSubsetStrategy="all")
    for a, b in zip(own.scores, spark_s.scores, strict=True):
        assert a == b | {"mse": pytest.approx(b["mse"], rel=1e-9)}


def test_blocks_and_pieces_do_not_change_errors(rows, monkeypatch):
    both = coded(rows)
    drawn = M.forest(numTrees=7, maxDepth=4, minInstancesPerNode=2, featureSubsetStrategy="sqrt")
    pack = W.packed(both, drawn, "__fold")
    once = W.validated(both, pack, [(0, drawn), (2, drawn)], [3, 7], [1, 4])
    monkeypatch.setattr(W, "BLOCK_ROWS", 23)
    monkeypatch.setattr(W, "TASKS_PER_CORE", 1)
    again = W.validated(both, pack, [(0, drawn), (2, drawn)], [3, 7], [1, 4])
    for a, b in zip(once, again, strict=True):
        assert a == {k: (pytest.approx(total, rel=1e-9), n) for k, (total, n) in b.items()}


def test_labels_must_be_known(rows):
    unknown = coded(rows.withColumn(M.LABEL, F.when(F.col("id") > 3, F.col(M.LABEL))))
    with pytest.raises(ValueError, match="NaN"):
        W.packed(unknown, M.forest())


def test_thresholds_leave_equal_shares():
    values = T.np.repeat(T.np.arange(1000.0), 3)
    parts = [T.summary(values[k::2], most=100) for k in range(2)]
    assert all(len(v) == 100 and n.sum() == 1500 for v, n in parts)
    edges = T.thresholds(*(T.np.concatenate(x) for x in zip(*parts)), 8)
    assert edges == pytest.approx([1000 * k / 8 for k in range(1, 8)], abs=15)
    assert T.thresholds(T.np.array([3.0, 1.0, 3.0]), T.np.array([1, 2, 3]), 32) == pytest.approx([2.0])
    assert [T.subset_size(s, 20, 9) for s in ("auto", "all", "sqrt", "log2", "onethird", "3", "0.5")] == [7, 20, 5, 5, 7, 3, 10]


@pytest.mark.parametrize("subset", ["all", "sqrt"])
def test_trees_of_several_leaf_sizes_are_grown_at_once(rows, subset):
    """They share nodes while they split alike, and draw the same rows: without a choice of features nothing else changes."""
    both, least = coded(rows), [40, 2, 9]
    each = [M.forest(numTrees=6, maxDepth=5, minInstancesPerNode=k, featureSubsetStrategy=subset) for k in least]
    pack = W.packed(both, each[0], "__fold")
    found = W.validated(both, pack, [(1, e) for e in each], [6], [2, 5])
    for k, e, one in zip(least, each, found, strict=True):
        (alone,) = W.validated(both, pack, [(1, e)], [6], [2, 5])
        tolerance = 1e-9 if subset == "all" else 0.35
        assert one == {key: (pytest.approx(total, rel=tolerance), n) for key, (total, n) in alone.items()}, k
    assert len({one[6, 5][0] for one in found}) == 3
    settings, label = T.Settings.of(each[0], 4, 6), pack.label
    sizes = [len(e) + 1 for e in pack.edges]
    for tree, bound in enumerate(sorted(least)):
        for level in T.grow(pack.columns, label, sizes, settings, sorted(least), T.np.random.default_rng(3), 5):
            inner = level.feature[tree] >= 0
            assert (level.weight[inner] >= 2 * bound).all()
