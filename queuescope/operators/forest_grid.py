"""Grid search over forests that grows one forest for all numbers of trees and all depths.

The first trees of a large forest are a smaller forest, and a tree cut at a depth, its inner nodes there
taken as leaves, is a shallower tree: both are what a fit of their own would give, but for the random
draws. So a fit is needed only for each choice of the other settings, and one pass over the validation
rows scores all numbers of trees and all depths.

Rows whose binned features fit one task are sent to all of them, and each task grows and scores some trees of
some fits (see ``grown``). More rows are fitted by Spark, one forest over all tasks.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope import vocab
from queuescope.operators import grown
from queuescope.operators import model as M
from queuescope.session import cut_lineage, ensure_checkpoint_dir

TREES, DEPTH = "numTrees", "maxDepth"


def node_table(model: RandomForestRegressionModel, rows: DataFrame) -> pd.DataFrame:
    """(tree, node, left, right, value) of a fitted forest, from its stored form; leaves have children -1.

    The forest itself is on the driver, so its nodes may be too.
    """
    path = posixpath.join(ensure_checkpoint_dir(rows.sparkSession), f"forest-{uuid.uuid4().hex}")
    model.write().save(path)
    nodes = rows.sparkSession.read.parquet(posixpath.join(path, "data"))
    columns = {"node": "id", "left": "leftChild", "right": "rightChild", "value": "prediction"}
    table = nodes.select(F.col("treeID").alias("tree"), *[F.col(f"nodeData.{c}").alias(n) for n, c in columns.items()])
    return table.toPandas().sort_values(["tree", "node"], ignore_index=True)


def cut_values(nodes: pd.DataFrame, depths: Sequence[int]) -> pd.DataFrame:
    """(tree, leaf, d0, d1, ...): for each leaf the value of its tree when cut at each of ``depths``.

    Nodes are numbered from the root downwards and from left to right, and so are the leaves that a
    model names in its leaf column.
    """
    start = nodes.groupby("tree")["node"].transform("size").groupby(nodes["tree"]).first().cumsum().shift(fill_value=0)
    base = nodes["tree"].map(start).to_numpy()
    left, right, value = (nodes[c].to_numpy() for c in ("left", "right", "value"))
    level = np.flatnonzero(nodes["node"].to_numpy() == 0)
    kept = np.tile(value[:, None], (1, len(depths)))
    at = 0
    while len(level):
        inner = level[left[level] >= 0]
        down = []
        for child in (left, right):
            below = base[inner] + child[inner]
            for j, depth in enumerate(depths):
                if at >= depth:  # the parent is a leaf of the cut tree, or lies below one
                    kept[below, j] = kept[inner, j]
            down.append(below)
        level, at = np.concatenate(down), at + 1
    leaves = np.flatnonzero(left < 0)
    out = pd.DataFrame({"tree": nodes["tree"].to_numpy()[leaves]})
    out["leaf"] = out.groupby("tree").cumcount()
    return out.assign(**{f"d{j}": kept[leaves, j] for j in range(len(depths))})


def prefix_errors(
    model: RandomForestRegressionModel, rows: DataFrame, trees: Sequence[int], depths: Sequence[int]
) -> dict[tuple[int, int], tuple[float, int]]:
    """Sum of squared errors and number of rows for each (number of trees, depth), in one pass.

    Each row says in which leaf of each tree it falls; tasks look up the leaves' values at all depths and
    average them over the first trees, so no row is copied for its trees and nothing is shuffled.
    """
    values = cut_values(node_table(model, rows), depths)
    first = np.searchsorted(values["tree"].to_numpy(), np.arange(model.getNumTrees))
    sent = rows.sparkSession.sparkContext.broadcast((first, values[[f"d{j}" for j in range(len(depths))]].to_numpy()))
    named = model.copy().setLeafCol("__leaf").transform(rows)
    both = list(product(range(len(trees)), range(len(depths))))

    def errors(batches):
        start, kept = sent.value
        for batch in batches:
            label = batch.column("label").to_numpy()
            leaf = batch.column("leaf").flatten().to_numpy().astype(np.int64).reshape(len(label), len(start))
            parts = [len(label)]
            for n, j in [(trees[i], j) for i, j in both]:
                off = kept[start[:n] + leaf[:, :n], j].sum(axis=1) / n - label
                parts.append(float(off @ off))
            yield pa.RecordBatch.from_pydict({f"s{k}": [v] for k, v in enumerate(parts)})

    schema = "s0 bigint, " + ", ".join(f"s{k + 1} double" for k in range(len(both)))
    leaves = named.select(F.col(M.LABEL).cast("double").alias("label"), vector_to_array("__leaf").alias("leaf"))
    sums = leaves.mapInArrow(errors, schema).agg(*[F.sum(f"s{k}") for k in range(len(both) + 1)]).first()
    sent.destroy()
    return {(trees[i], depths[j]): (sums[k + 1] or 0.0, sums[0] or 0) for k, (i, j) in enumerate(both)}


@dataclass
class Search:
    """The refitted best forest, and settings and mean validation error of every grid point."""

    best: PipelineModel
    scores: list[dict]


def search(
    train: DataFrame,
    features: Sequence[str],
    grid: dict[str, Sequence] | None = None,
    folds: int = vocab.FOLDS,
    parallelism: int = 8,
    session: str = "session_id",
    fold_by: str = "session",
    **settings,
) -> Search:
    """Cross-validated search over all of ``grid``, scored by mean squared error on the log scale.

    One forest per fold and choice of the settings other than ``numTrees`` and ``maxDepth``; 45 fits for
    the 270 of the full grid. ``settings`` hold for all forests. Of equal errors the first setting wins,
    and it is fitted once more on all rows. Folds are made as in ``model.grid_search``.
    """
    grid = grid or vocab.FOREST_GRID
    trees, depths = (sorted(grid.get(name, [default])) for name, default in ((TREES, 20), (DEPTH, 5)))
    others = [name for name in grid if name not in (TREES, DEPTH)]
    choices = [dict(zip(others, values, strict=True)) for values in product(*[grid[name] for name in others])]
    assembler = M.assembler(features)
    dealt = M.with_folds(train, folds, session, fold_by).withColumnRenamed("fold", "__fold")
    rows = cut_lineage(assembler.transform(dealt).select("features", M.LABEL, "__fold"))
    fits = [(fold, choice, M.forest(**settings, **choice, numTrees=trees[-1], maxDepth=depths[-1]))
            for fold, choice in product(range(folds), choices)]
    one_binning = len({estimator.getMaxBins() for _, _, estimator in fits}) == 1
    pack = grown.packed(rows, fits[0][2], "__fold") if one_binning else None
    if pack:
        errors = grown.validated(rows, pack, [(fold, estimator) for fold, _, estimator in fits], trees, depths)
    else:
        errors = _fitted_by_spark(rows, fits, folds, trees, depths, parallelism)
    found = [{k: error / max(1, n) for k, (error, n) in each.items()} for each in errors]
    scores = []
    for choice, n, depth in product(choices, trees, depths):
        own = [errors[n, depth] for (_, c, _), errors in zip(fits, found, strict=True) if c is choice]
        scores.append({TREES: n, DEPTH: depth, **choice, "mse": float(np.mean(own))})
    best = min(scores, key=lambda s: s["mse"])
    final = M.forest(**settings, **{k: v for k, v in best.items() if k != "mse"})
    model = grown.fitted(rows, pack, final) if pack else final.setCacheNodeIds(True).fit(rows.repartition(_parts(rows)))
    return Search(PipelineModel(stages=[assembler, model]), scores)


def _parts(rows: DataFrame) -> int:
    return M.fit_parts(rows.count(), rows.sparkSession.sparkContext.defaultParallelism)


def _fitted_by_spark(rows: DataFrame, fits, folds: int, trees, depths, parallelism: int) -> list[dict]:
    """What ``grown.validated`` gives, where the rows are too many for one task: each forest is fitted over all tasks."""
    parts, held = _parts(rows), []
    for fold in range(folds):
        held.append([cut_lineage(rows.filter(c).repartition(parts)) for c in (f"__fold <> {fold}", f"__fold = {fold}")])

    def fit(task: tuple) -> dict[tuple[int, int], tuple[float, int]]:
        fold, _, estimator = task
        known, unseen = held[fold]
        return prefix_errors(estimator.setCacheNodeIds(True).fit(known), unseen, trees, depths)

    at_once = max(parallelism, rows.sparkSession.sparkContext.defaultParallelism)
    with ThreadPool(min(at_once, len(fits))) as pool:
        return pool.map(inheritable_thread_target(rows.sparkSession)(fit), fits, chunksize=1)
