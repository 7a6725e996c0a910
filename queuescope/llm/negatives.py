"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queuescope.llm.common import Scratch

#: Anchors that meet the rows in one pass; they and what is known of their windows are on the driver.
ANCHORS = 4_000
#: Anchors of a pass whose scores are accumulated together, and dimensions between two prunings.
LANES = 256
STEP = 16
#: Rows behind one index.
BLOCK_ROWS = 10_000

#: Thresholds of the search for positives, as shares of the anchor's own score; at last there is none.
POSITIVE_SHARES = (0.8, 0.4, None)
#: Thresholds of the search in a window, as shares of the positive's score; the last must be the window's lower end.
WINDOW_PERCENT = (95, 88, 80)

_LOW = -(1 << 62)
#: Norms are rounded; bounds are raised by more than that.
_SLACK = 1 + 1e-9


@dataclass
class Anchors:
    """Anchors of a pass: row numbers, labels, vectors in the order of the dimensions, suffix norms."""

    row: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray


def suffix_norms(vectors: np.ndarray) -> np.ndarray:
    """(rows, steps + 1): the norm of each vector from every step's first dimension on."""
    square = np.cumsum((vectors * vectors)[:, ::-1], axis=1)[:, ::-1]
    square = np.concatenate([square, np.zeros((len(vectors), 1))], axis=1)
    edges = [*range(0, vectors.shape[1], STEP), vectors.shape[1]]
    return np.sqrt(square[:, edges])


class Index:
    """Lists of the rows of a block by dimension, without what the suffix norms cover.

    For anchors whose suffixes from a step on have norms up to ``reach``, a row whose own suffix norm
    times ``reach`` stays below the threshold cannot gain enough there, so the dimensions from that
    step on are left out of its lists. Rows are sorted by how many steps they keep: each list is the
    first part of the block.
    """

    def __init__(self, vectors: np.ndarray, norms: np.ndarray, reach: np.ndarray, threshold: float):
        kept = (norms[:, :-1] * reach[:-1] * _SLACK >= threshold).sum(axis=1)
        self.order = np.argsort(-kept, kind="stable")
        self.vectors, self.norms = vectors[self.order], norms[self.order]
        self.kept = kept[self.order]
        self.listed = [int(np.searchsorted(-self.kept, -step, "left")) for step in range(norms.shape[1] - 1)]
        # listed[s]: rows whose kept steps are more than s
        self.steps = [slice(k, min(k + STEP, vectors.shape[1])) for k in range(0, vectors.shape[1], STEP)]

    def search(self, q: np.ndarray, q_norms: np.ndarray, least: np.ndarray, eligible: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) whose score may reach the anchor's threshold, out of the eligible pairs.

        Partial scores are accumulated list by list. After each step a row goes on only if the partial
        score and the product of the remaining norms reach the threshold for some anchor.
        """
        rows = np.arange(self.listed[0] if self.listed else 0)
        score = np.zeros((len(q), len(rows)))
        alive = eligible[:, self.order[rows]]
        out = []
        for s, part in enumerate(self.steps):
            ends = self.kept[rows] == s  # all their lists are read: the rest is bounded by the norms
            if ends.any():
                out.append(self._near(score, alive, rows, ends, q_norms[:, s], s, least))
                rows, score, alive = rows[~ends], score[:, ~ends], alive[:, ~ends]
            if not len(rows):
                break
            score += q[:, part] @ self.vectors[rows, part].T
            alive &= score + q_norms[:, s + 1, None] * self.norms[rows, s + 1] * _SLACK >= least[:, None]
            going = alive.any(axis=0)
            if not going.all():
                rows, score, alive = rows[going], score[:, going], alive[:, going]
        if len(rows):
            out.append(self._near(score, alive, rows, np.ones(len(rows), bool), q_norms[:, -1], len(self.steps), least))
        anchor = np.concatenate([a for a, _ in out]) if out else np.zeros(0, np.int64)
        return anchor, self.order[np.concatenate([r for _, r in out])] if out else np.zeros(0, np.int64)

    def _near(self, score, alive, rows, which, q_norm, step, least) -> tuple[np.ndarray, np.ndarray]:
        bound = score[:, which] + q_norm[:, None] * self.norms[rows[which], step] * _SLACK
        anchor, row = np.nonzero(alive[:, which] & (bound >= least[:, None]))
        return anchor, rows[which][row]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of pairs of vectors."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 100_000):
        part = slice(at, at + 100_000)
        out[part] = np.einsum("ij,ij->i", a[part].astype(np.int64), b[part].astype(np.int64))
    return out


def _first(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of each window."""
    found = found.sort_values(["window", "score", "no_id", "id", "row"], ascending=[True, False, True, True, True])
    return found[found.groupby("window").cumcount().to_numpy() < k]


def _vectors(column: pa.Array, place: np.ndarray) -> np.ndarray:
    """Rows of numbers, filled up with zeros, in the order of the dimensions."""
    lengths = pc.list_value_length(column).to_numpy()
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), len(place)))
    if len(flat):
        row = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[row, place[inside]] = flat
    return out


@dataclass
class Search:
    """What a pass looks for: the best ``k`` rows in each window of scores of an anchor."""

    anchors: Anchors
    anchor: np.ndarray  #: of each window, sorted
    high: np.ndarray  #: largest score of the window
    low: np.ndarray  #: smallest score that this pass looks for
    same_label: bool
    k: int

    def run(self, rows: DataFrame, place: np.ndarray) -> DataFrame:
        """(window, score, id, row): at most ``k`` rows for a window and a task."""

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["window", "score", "no_id", "id", "row"]
            best = pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
            low = self.low.copy()
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK_ROWS):
                    batch = whole.slice(at, BLOCK_ROWS)
                    found = self._block(batch, place, low)
                    if len(found):
                        best = _first(pd.concat([best, found]), self.k)
                        # A window that is full here wants nothing below its last.
                        size = best.groupby("window")["score"].agg(["size", "min"])
                        full = size[size["size"] == self.k]
                        low[full.index] = np.maximum(low[full.index], full["min"])
            ids = pa.array(best["id"].to_numpy(), mask=best["no_id"].to_numpy() > 0)
            columns = [pa.array(best["window"].to_numpy()), pa.array(best["score"].to_numpy()), ids, pa.array(best["row"].to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, names=["window", "score", "id", "row"])

        return rows.select("row", "id", "label", "vector").mapInArrow(search, "window long, score long, id long, row long")

    def _block(self, batch: pa.RecordBatch, place: np.ndarray, low: np.ndarray) -> pd.DataFrame:
        row, label = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        ids = pc.fill_null(batch.column(1), 0).to_numpy()
        no_id = pc.is_null(batch.column(1)).to_numpy(zero_copy_only=False)
        vectors = _vectors(batch.column(3), place)
        norms = suffix_norms(vectors)
        out = []
        # Anchors that still have a window; the least score that one of its windows wants.
        wanted, first = np.unique(self.anchor, return_index=True)
        least = np.minimum.reduceat(low, first) if len(first) else np.zeros(0)
        for at in range(0, len(wanted), LANES):
            lanes, floor = wanted[at : at + LANES], least[at : at + LANES]
            q, q_norms = self.anchors.vectors[lanes], self.anchors.norms[lanes]
            eligible = (self.anchors.label[lanes, None] == label) == self.same_label
            eligible &= self.anchors.row[lanes, None] != row
            index = Index(vectors, norms, q_norms.max(axis=0), floor.min())
            lane, hit = index.search(q, q_norms, floor, eligible)
            if len(lane):
                score = _exact(q[lane], vectors[hit])
                out += self._in_windows(at + lane, hit, score, low, first, len(wanted))
        if not out:
            return pd.DataFrame()
        window, hit, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"window": window, "score": score, "no_id": no_id[hit].astype(np.int64), "id": ids[hit], "row": row[hit]})

    def _in_windows(self, lane, hit, score, low, first, n) -> list[tuple]:
        """Each found pair in all windows of its anchor that its score lies in."""
        number = np.diff(np.append(first, len(self.anchor)))
        out = []
        for j in range(int(number.max())):
            has = number[lane] > j
            window = first[lane[has]] + j
            inside = (score[has] <= self.high[window]) & (score[has] >= low[window])
            out.append((window[inside], hit[has][inside], score[has][inside]))
        return out


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _energy(rows: DataFrame) -> np.ndarray:
    """The place of each dimension when they are sorted by their sum of squares, largest first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0)
        for batch in batches:
            most = pc.max(pc.list_value_length(batch.column(0))).as_py() or 0
            own = (_vectors(batch.column(0), np.arange(most)) ** 2).sum(axis=0)
            size = max(len(total), len(own))
            total = np.pad(total, (0, size - len(total))) + np.pad(own, (0, size - len(own)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["dim", "energy"])

    sums = rows.select("vector").mapInArrow(add, "dim long, energy double").groupBy("dim").agg(F.sum("energy").alias("energy"))
    order = [r.dim for r in sums.orderBy(F.col("energy").desc(), "dim").collect()]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


class Miner:
    """One job of mining; intermediate tables are in the shared folder."""

    def __init__(self, rows: DataFrame, scratch: Scratch, positives: int, negatives: int):
        self.scratch, self.spark = scratch, rows.sparkSession
        self.positives, self.negatives = positives, negatives
        self.rows = scratch.store(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        self.place = _energy(self.rows)
        self.found_path, self.windows_path = f"{scratch.folder}/found", f"{scratch.folder}/windows"
        self._append([], "window long, score long, id long, row long, rank int, turn int", self.found_path)
        self._append([], _WINDOWS, self.windows_path)

    def _append(self, rows: list, schema: str, path: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def mine(self, is_anchor) -> DataFrame:
        anchors = self.rows.where(is_anchor)
        passes = -(-anchors.count() // ANCHORS)
        for turn in range(passes):
            self._pass(anchors.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == turn), turn)
        found = self.spark.read.parquet(self.found_path)
        windows = self.spark.read.parquet(self.windows_path)
        return windows.join(found, ["turn", "window"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )

    def _pass(self, chosen: DataFrame, turn: int) -> None:
        table = chosen.select("row", "id", "label", "vector").toArrow().combine_chunks()
        if not table.num_rows:
            return
        vectors = _vectors(table.column("vector").combine_chunks(), self.place)
        row, label = table.column("row").to_numpy(), table.column("label").to_numpy()
        ids = table.column("id").to_pylist()
        anchors = Anchors(row, label, vectors, suffix_norms(vectors))
        told = self._positives(anchors)
        windows = [(a, positive, score) for a in range(len(row)) for positive, score in told.get(a, []) if score >= 0]
        anchor = np.array([a for a, _, _ in windows], np.int64)
        score = np.array([s for _, _, s in windows], np.int64)
        left = np.arange(len(windows))
        for k, percent in enumerate(WINDOW_PERCENT):
            if not len(left):
                break
            # 100 * negative >= percent * positive, in whole numbers
            low = -(-percent * score[left] // 100)
            search = Search(anchors, anchor[left], score[left], low, False, self.negatives)
            best = _best(search.run(self.rows, self.place), self.negatives)
            best = self.scratch.store(best, f"turn{turn}-{k}")
            number = np.zeros(len(left), np.int64)
            for r in best.groupBy("window").count().collect():
                number[r.window] = r["count"]
            settled = (number == self.negatives) | (k == len(WINDOW_PERCENT) - 1)
            at = turn * len(WINDOW_PERCENT) + k
            best.withColumn("turn", F.lit(at)).write.mode("append").parquet(self.found_path)
            done = [windows[i] for i in left[settled]]
            self._append(
                [(at, int(w), ids[a], positive, s) for w, (a, positive, s) in zip(np.flatnonzero(settled), done, strict=True)],
                _WINDOWS,
                self.windows_path,
            )
            left = left[~settled]

    def _positives(self, anchors: Anchors) -> dict[int, list[tuple[int | None, int]]]:
        """The first rows of the same label for each anchor, as (id, score)."""
        own = (anchors.vectors**2).sum(axis=1)
        left = np.arange(len(anchors.row))
        out: dict[int, list[tuple[int | None, int]]] = {}
        for share in POSITIVE_SHARES:
            if not len(left):
                break
            low = np.full(len(left), _LOW) if share is None else np.ceil(share * own[left]).astype(np.int64)
            search = Search(anchors, left, np.full(len(left), -_LOW), low, True, self.positives)
            found: dict[int, list] = {}
            for r in _best(search.run(self.rows, self.place), self.positives).orderBy("window", "rank").collect():
                found.setdefault(int(left[r.window]), []).append((r.id, r.score))
            settled = np.array([share is None or len(found.get(a, [])) == self.positives for a in left.tolist()])
            out |= {a: found.get(a, []) for a in left[settled].tolist()}
            left = left[~settled]
        return out


_WINDOWS = "turn int, window long, anchor_id long, positive_id long, positive_score long"


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, vector of whole numbers) of the rows with a label and finite components.

    A component x becomes the largest whole number that is not above 256 * x.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vector = F.col(vector_col).cast("array<double>")
    return rows.where(F.col(label_col).isNotNull() & vector.isNotNull() & F.forall(vector, finite)).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x * 256).cast("long")).alias("vector"),
    )


def hard_negatives(
    rows: DataFrame,
    is_anchor,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 5,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``. A row's score is its inner product with the anchor, in whole
    numbers; higher scores come first, then smaller ids. An anchor's positives are its first other rows
    of the same label, its negatives for a positive the first rows of another label whose score is at
    most the positive's and at least 80 percent of it.

    Anchors meet all rows, some thousand anchors in a pass. A task indexes its rows by dimension; partial
    scores are accumulated, and rows fall away as soon as the remaining norms cannot lift them to the
    threshold. Thresholds begin high and are lowered for the windows that are not full.

    Rows with a NULL label, a NULL vector or a component that is NULL or not finite take no part. Vectors
    of unequal length count as filled up with zeros. A row without an id is no anchor and comes after
    others of its score. Repeated rows are rows of their own: an anchor may have its own copy as a
    positive, and a repeated anchor gives its rows once more. Inner products must stay below 2**53.
    A positive with a negative score has no negatives. No anchors give an empty result. Other columns
    are not read.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    return Miner(usable(rows, id_col, label_col, vector_col), scratch, positives, negatives).mine(is_anchor)
