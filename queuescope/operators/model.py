"""Random-forest latency model: rows, splits, fitting, scoring."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuescope import vocab
from queuescope.functions.fields import from_log_target, log_target
from queuescope.operators import grown
from queuescope.operators.errors import with_errors
from queuescope.operators.scan import Limits, ScanPlan, position
from queuescope.session import cut_lineage

LABEL = "log_latency"
#: Sessions that are numbered in one task.
SESSION_LIMITS = Limits(group_rows=50_000, slice_rows=25_000)
#: Rows of one partition while a single forest is fitted, where there are more than cores times as many.
FIT_ROWS = 1_000_000
PREDICTED = "prediction"
_LAG_COLUMN = re.compile(r"_lag_[0-9]+$")


def feature_names(df: DataFrame, base: Sequence[str] = vocab.BASE_FEATURES) -> list[str]:
    """Model inputs: the base features and every lag column of ``df``."""
    names = [*base, *[c for c in df.columns if _LAG_COLUMN.search(c)]]
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return names


def model_rows(
    df: DataFrame, target: str = "e2etime", session: str | None = None,
    base: Sequence[str] = vocab.BASE_FEATURES,
) -> DataFrame:
    """Rows without NULL in target, features (and session), with the target on a log scale."""
    needed = [target, *feature_names(df, base)]
    if session is not None and session in df.columns:
        needed.append(session)
    return df.na.drop(subset=needed).withColumn(LABEL, log_target(F.col(target)))


def hash_percent(*columns: str) -> Column:
    """0..99 from the text of the columns; the same under any partitioning."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10)
    return head.cast("bigint") % 100


def random_split(
    df: DataFrame, keys: Sequence[str] = ("session_id", "tid"), test_share=vocab.TEST_SHARE
) -> DataFrame:
    """Mark about ``test_share`` of the rows as ``is_test``, by a hash of their keys."""
    return df.withColumn("is_test", hash_percent(*keys) < F.lit(round(test_share * 100)))


def session_split(
    df: DataFrame, test_sessions: Iterable[int] | None, session: str = "session_id"
) -> DataFrame:
    """Mark whole sessions as ``is_test``."""
    if test_sessions is None:
        raise ValueError("test_sessions must be given for a split by session")
    if session not in df.columns:
        raise ValueError(f"session column {session!r} not found")
    return df.withColumn("is_test", F.col(session).isin(list(test_sessions)))


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features")


def forest(**settings) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", labelCol=LABEL, predictionCol=PREDICTED, seed=vocab.SEED, **settings
    )


def fit_forest(train: DataFrame, features: Sequence[str], **settings) -> PipelineModel:
    """A forest with the given settings behind an assembler that fixes the feature order.

    In each pass every task reports the statistics of all nodes of the level, whose number grows with the
    rows. So the tasks are as many as the cores and do not grow, too, until each has ``FIT_ROWS`` rows; and
    rows keep the number of their node, so that the trees so far need not be sent to every task.
    """
    rows = train.select(*dict.fromkeys([*features, LABEL]))
    parts = fit_parts(rows.count(), train.sparkSession.sparkContext.defaultParallelism)
    stages = [assembler(features), forest(cacheNodeIds=True, **settings)]
    return Pipeline(stages=stages).fit(rows.repartition(parts))


def fit_parts(rows: int, cores: int) -> int:
    """Partitions of a fit: one per core, and more only if each would have more than ``FIT_ROWS`` rows."""
    return max(cores, -(-rows // FIT_ROWS))


def baseline_forest(train: DataFrame, features: Sequence[str], max_depth: int = 30) -> PipelineModel:
    """Few trees with a minimum leaf size. Depth is bounded by what Spark's trees allow.

    Each is grown in one task, unless the binned rows are too many for it (see ``grown``).
    """
    settings = {
        "numTrees": vocab.BASELINE_TREES,
        "minInstancesPerNode": vocab.BASELINE_MIN_LEAF,
        "maxDepth": max_depth,
        "featureSubsetStrategy": "all",
    }
    vectors, estimator = assembler(features), forest(**settings)
    pack = grown.packed(train, estimator, names=features)
    if pack is None:
        return fit_forest(train, features, **settings)
    return PipelineModel(stages=[vectors, grown.fitted(vectors.transform(train), pack, estimator)])


def grid_search(
    train: DataFrame,
    features: Sequence[str],
    grid: dict[str, Sequence] | None = None,
    folds: int = vocab.FOLDS,
    parallelism: int = 4,
    session: str = "session_id",
    fold_by: str = "session",
) -> tuple[PipelineModel, CrossValidatorModel]:
    """Cross-validated search over ``grid``, scored by mean squared error: best model and search.

    Folds are made of whole sessions, so that no session is in training and validation at once (see
    ``with_folds``). The feature vectors are made once and stored; the fits read label, vector and fold.
    """
    grid = grid or vocab.FOREST_GRID
    estimator = forest()
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    vectors = assembler(features)
    dealt = with_folds(train, folds, session, fold_by).withColumnRenamed("fold", "__fold")
    search_rows = cut_lineage(vectors.transform(dealt).select("features", LABEL, "__fold"))
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=builder.build(),
        evaluator=RegressionEvaluator(labelCol=LABEL, predictionCol=PREDICTED, metricName="mse"),
        numFolds=folds,
        parallelism=parallelism,
        foldCol="__fold",
        seed=vocab.SEED,
    )
    found = search.fit(search_rows)
    return PipelineModel(stages=[vectors, found.bestModel]), found


def session_folds(rows: DataFrame, folds: int = vocab.FOLDS, session: str = "session_id") -> DataFrame:
    """(session, fold): the sessions in sorted order are dealt out in turn, however many there are."""
    sessions = rows.select(session).filter(F.col(session).isNotNull()).distinct()
    plan = ScanPlan.measure(sessions, limits=SESSION_LIMITS)
    numbered = plan.compute(sessions, [], [session], __place=position())
    return numbered.select(session, ((F.col("__place") - 1) % folds).cast("int").alias("fold"))


def with_folds(
    rows: DataFrame,
    folds: int = vocab.FOLDS,
    session: str = "session_id",
    fold_by: str = "session",
    keys: Sequence[str] = ("session_id", "tid"),
) -> DataFrame:
    """Add ``fold``. There must be as many sessions as folds, unless the caller asks for
    ``fold_by="row"``, which deals out single rows by a hash of their ``keys``."""
    if fold_by == "row":
        return rows.withColumn("fold", (hash_percent(*keys) % folds).cast("int"))
    if fold_by != "session":
        raise ValueError(f"fold_by must be 'session' or 'row', not {fold_by!r}")
    found = rows.select(session).filter(F.col(session).isNotNull()).distinct().limit(folds).count()
    if found < folds:
        raise ValueError(f"{found} sessions cannot make {folds} folds of whole sessions")
    return rows.join(session_folds(rows, folds, session), session)


def grid_scores(search: CrossValidatorModel) -> list[dict]:
    """Settings and mean validation error of each grid point."""
    return [
        {**{p.name: v for p, v in point.items()}, "mse": float(error)}
        for point, error in zip(search.getEstimatorParamMaps(), search.avgMetrics)
    ]


def feature_importance(model: PipelineModel) -> list[tuple[str, float]]:
    """Feature and importance, most important first."""
    names = model.stages[0].getInputCols()
    weights = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, weights)), key=lambda f: (-f[1], f[0]))


def score(model: PipelineModel, rows: DataFrame, target: str = "e2etime") -> DataFrame:
    """Predictions, on the log scale and in seconds, and their errors."""
    return with_errors(predict(model, rows), target, "rf_prediction")


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``predicted_log`` and ``rf_prediction`` (seconds) for every row of a table.

    A row with a NULL feature stays, with NULL predictions. The stored assembler fixes the feature order.
    """
    assembler, *rest = model.stages
    names = assembler.getInputCols()
    known = F.lit(True)
    for name in names:
        known = known & F.col(name).isNotNull()
    keep = assembler.copy({assembler.handleInvalid: "keep"})
    scored = PipelineModel(stages=[keep, *rest]).transform(rows)
    logged = F.when(known, F.col(PREDICTED))
    return scored.select(
        *rows.columns, logged.alias("predicted_log"), from_log_target(logged).alias("rf_prediction")
    )


def model_metrics(scored: DataFrame, actual_log: str, predicted_log: str, keys=()) -> DataFrame:
    """R2 on the log scale, mean squared and absolute error in seconds; one aggregate."""
    y, p = F.col(actual_log), F.col(predicted_log)
    real = from_log_target(y) - from_log_target(p)
    residual = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(1.0) - F.try_divide(residual, spread)).alias("r2_log"),
        F.avg(real * real).alias("mse"),
        F.avg(F.abs(real)).alias("mae"),
    )


def results_table(scored: DataFrame, target: str = "e2etime") -> DataFrame:
    """Scored rows with the identifying columns that exist."""
    names = ["session_id", "fqdn", "tid", target, "rf_prediction", "absolute_error",
             "squared_error", "percentage_relative_error", "is_test"]
    return scored.select(*[c for c in names if c in scored.columns])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
