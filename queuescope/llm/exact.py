"""Exact dedup by a tree merge of sorted digest runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.llm.common import BLANKS, Scratch, keep_rows, numbered

#: Runs that meet in one merge; each merge also cuts its result into so many digest ranges.
FAN_BITS = 4

#: One entry for a digest: four words of the digest, bytes of the normalised text, code points and
#: identity of the row that stays, and the rows that have the text.
ENTRY = np.dtype(
    [(f"d{k}", "<u8") for k in range(4)]
    + [("size", "<i8"), ("points", "<i8"), ("no_id", "<i8"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8")]
)
DIGEST = ["d0", "d1", "d2", "d3", "size"]


def _merge(entries: np.ndarray) -> np.ndarray:
    """Sort by digest and keep one entry of each, the best row with the number of all rows.

    Two texts count as equal when the whole digest and the length agree.
    """
    if not len(entries):
        return entries
    keys = [entries[k] for k in ("row", "id", "no_id")] + [-entries["points"]]
    entries = entries[np.lexsort(keys + [entries[k] for k in reversed(DIGEST)])]
    new = np.ones(len(entries), bool)
    new[1:] = np.any([entries[k][1:] != entries[k][:-1] for k in DIGEST], axis=0)
    first = np.flatnonzero(new)
    out = entries[first]
    out["n"] = np.add.reduceat(entries["n"], first)
    return out


def _entries(digests: list[bytes], sizes, points, ids: pa.Array, rows) -> np.ndarray:
    out = np.zeros(len(digests), ENTRY)
    words = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4)
    for k in range(4):
        out[f"d{k}"] = words[:, k]
    out["size"], out["points"], out["row"], out["n"] = sizes, points, rows, 1
    out["no_id"] = ids.is_null().to_numpy(zero_copy_only=False)
    out["id"] = pc.fill_null(ids, 0).to_numpy()
    return out


def digest_rows(docs: DataFrame, id_col: str, text_col: str, row: str) -> DataFrame:
    """Per row its digest; the last row of each task carries the sorted run of its entries."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = []
        for batch in batches:
            ids, texts, rows = (batch.column(k) for k in range(3))
            normal = [(t or "").encode().translate(None, BLANKS) for t in texts.to_pylist()]
            digests = [hashlib.sha256(t).digest() for t in normal]
            points = pc.fill_null(pc.utf8_length(texts), 0).to_numpy()
            run.append(_merge(_entries(digests, [len(t) for t in normal], points, ids, rows.to_numpy())))
            if len(run) > 8:
                run = [_merge(np.concatenate(run))]
            yield pa.RecordBatch.from_arrays(
                [rows, ids, pa.array(digests, pa.binary()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary())],
                names=["row", "id", "digest", "run", "entries"],
            )
        if run:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([TaskContext.get().partitionId()], pa.int64()),
                 pa.array([_merge(np.concatenate(run)).tobytes()], pa.binary())],
                names=["row", "id", "digest", "run", "entries"],
            )

    narrow = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), row)
    return narrow.mapInArrow(digest, "row long, id long, digest binary, run long, entries binary")


def merge_runs(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """Merge sorted runs in rounds until every digest range has one run.

    In a round, the runs of one digest range meet in groups of ``2**FAN_BITS``; a merged run is cut
    into as many finer ranges. So the number of runs and their length stay about the same from
    round to round, and no task ever holds more than ``2**FAN_BITS`` of them, however many rows
    there are. A digest is in a run once, so a text with many copies weighs no more than any other.
    """
    fan = 1 << FAN_BITS

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        merged = _merge(np.concatenate([np.frombuffer(x, ENTRY) for x in group["entries"]]))
        run, part, depth = group["run"].iloc[0] // fan, group["part"].iloc[0], int(group["depth"].iloc[0])
        shift = 64 - FAN_BITS * (depth + 1)
        if shift < 0:  # as fine as it gets
            return pd.DataFrame({"run": [run], "part": [part], "depth": [depth], "entries": [merged.tobytes()]})
        finer = (merged["d0"] >> np.uint64(shift)).astype(np.int64) & (fan - 1)
        cuts = np.searchsorted(finer, np.arange(fan + 1))
        full = [k for k in range(fan) if cuts[k] < cuts[k + 1]]
        return pd.DataFrame(
            {"run": run, "part": [part * fan + k for k in full], "depth": depth + 1,
             "entries": [merged[cuts[k] : cuts[k + 1]].tobytes() for k in full]}
        )

    last = runs.agg(F.max("run")).first()[0] or 0
    runs = runs.select("run", F.lit(0).cast("long").alias("part"), F.lit(0).alias("depth"), "entries")
    level = 0
    while last > 0:
        merged = runs.groupBy(F.floor(F.col("run") / fan).alias("g"), "part").applyInPandas(
            meet, "run long, part long, depth int, entries binary"
        )
        runs = scratch.store(merged, f"runs{level}")
        last //= fan
        level += 1
    return runs


def _unpacked(runs: DataFrame) -> DataFrame:
    """Of each text with more than one row: digest, the row that stays, and the number of rows."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                e = np.frombuffer(value.as_py(), ENTRY)
                e = e[e["n"] > 1]
                words = np.stack([e[f"d{k}"] for k in range(4)], axis=1).astype(">u8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w.tobytes() for w in words], pa.binary()),
                     pa.array(e["id"].copy(), mask=e["no_id"] > 0), pa.array(e["row"].copy()), pa.array(e["n"].copy())],
                    names=["digest", "keep_id", "keep_row", "group_size"],
                )

    return runs.select("entries").mapInArrow(unpack, "digest binary, keep_id long, keep_row long, group_size long")


def _groups(docs: DataFrame, id_col: str, text_col: str, row: str, scratch: Scratch) -> DataFrame:
    stored = scratch.store(digest_rows(docs, id_col, text_col, row), "digests")
    runs = merge_runs(stored.where("run IS NOT NULL"), scratch)
    rows = stored.where("run IS NULL").select("row", "id", "digest")
    # One side has each digest once; adaptive execution splits the rows of a hot one.
    return rows.join(_unpacked(runs), "digest", "left").select(
        "row",
        F.col("id").alias("doc_id"),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("keep_row", "row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they agree after all ASCII white space is deleted. Of equal texts the one
    with the most code points in the original stays, of these the one with the smallest id.

    Ids are whole numbers. A NULL text counts as empty, and all empty texts are equal. A NULL id comes after all others.
    Repeated rows are equal texts; one of them stays, and ``group_size`` counts each. An empty table
    gives an empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    numbers = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).withColumn(
        "row_", F.monotonically_increasing_id()
    )
    return _groups(numbers, "id_", "text_", "row_", scratch).drop("row")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``docs``; the rules are those of ``exact_groups``."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows, row = numbered(docs, scratch)
    kept = _groups(rows, id_col, text_col, row, scratch).where("kept").select(F.col("row").alias(row))
    return keep_rows(rows, row, kept)
