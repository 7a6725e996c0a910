"""Replay of queues on a stream, and their state at arrivals."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from queuescope import vocab
from queuescope.streaming.traces import QUEUE_ROW, TIME

QUEUE = ["session_id", "queue"]
REPLAYED = f"{QUEUE_ROW}, len bigint, status string, delta bigint"

#: What is kept of a queue between batches: its state, and the rows that are still ahead of the watermark.
STATE = "len bigint, status string, pending binary"

# A name of this module, so that tasks need no other module of the package.
_INITIAL_STATE = vocab.INITIAL_STATE
_KINDS = {"bigint": "Int64", "int": "Int32"}
_COLUMNS = {name: _KINDS.get(kind, object) for name, kind in (c.split(" ") for c in REPLAYED.split(", "))}
#: The columns of a queue's rows but those of its key; times and kinds are never NULL.
_WAITING = {
    c: {"ts_ns": "int64", "kind": "int32"}.get(c, _COLUMNS[c])
    for c in (c.split(" ")[0] for c in QUEUE_ROW.split(", ")) if c not in QUEUE
}


def _last(given: np.ndarray) -> np.ndarray:
    """For each row the place of the last one up to it that is given; -1 where there is none."""
    return np.maximum.accumulate(np.where(given, np.arange(len(given)), -1))


def _step(rows: pd.DataFrame, length: int, status: str) -> tuple[pd.DataFrame, int, str]:
    """Sets and takes in order of time; a change at an arrival's time comes before it.

    Between two sets the length only falls, so it is the length set less the takes since, and not below 0.
    """
    if rows.empty:
        return rows.assign(len=[], status=[], delta=[]), length, status
    seq = rows["seq"].fillna(np.iinfo(np.int64).min).to_numpy("int64")
    rows = rows.iloc[np.lexsort((seq, rows["kind"].to_numpy(), rows["ts_ns"].to_numpy()))]
    change = rows["kind"].to_numpy() == 0
    given = rows["set_len"].notna().to_numpy()
    takes = change & ~given & (rows["take"].fillna(0).to_numpy("int64") != 0)
    gone, at = np.cumsum(takes), _last(change & given)
    level = np.where(at < 0, length, rows["set_len"].fillna(0).to_numpy("int64")[at])
    since = gone - np.where(at < 0, 0, gone[at])
    lengths = np.where(since > 0, np.maximum(level - since, 0), level)
    named = rows["set_status"].to_numpy()
    at = _last(change & rows["set_status"].fillna("").ne("").to_numpy())
    statuses = np.where(at < 0, status, named[at])
    delta = np.diff(lengths, prepend=length)
    return rows.assign(len=lengths, status=statuses, delta=delta), int(lengths[-1]), str(statuses[-1])


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows that the watermark has passed go through the queue in order; the others wait."""
    length, status, packed = state.get if state.exists else (0, _INITIAL_STATE, None)
    parts = [pickle.loads(packed)] if packed else []
    if not state.hasTimedOut:
        parts += [frame[list(_WAITING)].astype(_WAITING) for frame in frames]
    parts = [p for p in parts if len(p)] or [pd.DataFrame({c: [] for c in _WAITING}).astype(_WAITING)]
    pending = pd.concat(parts, ignore_index=True)
    watermark = state.getCurrentWatermarkMs()
    passed = pending["ts_ns"] < (watermark + 1) * 1_000_000  # a record of that time or later is not late
    out, length, status = _step(pending[passed], length, status)
    pending = pending[~passed]
    state.update((length, status, pickle.dumps(pending) if len(pending) else None))
    if len(pending):
        state.setTimeoutTimestamp(max(int(pending["ts_ns"].min()) // 1_000_000 + 1, watermark + 1))
    if len(out):
        named = {name: None if pd.isna(value) else value for name, value in zip(QUEUE, key, strict=True)}
        yield out.assign(**named)[list(_COLUMNS)].astype(_COLUMNS)


def replayed(rows: DataFrame) -> DataFrame:
    """Queue rows (see ``traces.QUEUE_ROW``) with ``len``, ``status`` and ``delta`` after each, as a stream.

    ``rows`` have a watermark on ``traces.TIME``. State is kept per queue: its length and status, and
    the rows that are ahead of the watermark. An event-time timer wakes a queue when the watermark
    passes its earliest waiting row, so rows are replayed in order of time however the batches are cut,
    and each row is put out once. Rows behind the watermark are dropped and counted by Spark.
    """
    # The condition names the time, so it stays above the watermark and end records still move it.
    is_row = F.when(F.col(TIME).isNotNull(), F.col("kind").isNotNull())
    groups = rows.filter(is_row).groupBy(*QUEUE)
    return groups.applyInPandasWithState(_advance, REPLAYED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def history(found: DataFrame) -> DataFrame:
    """The changes among replayed rows, in the form of ``operators.queues.queue_states``."""
    change = F.when(F.col("take") == 1, "dec").otherwise("set")
    return found.filter("kind = 0").select(*QUEUE, "ts_ns", "seq", change.alias("change"), "len", "status", "delta")


def at_arrivals(found: DataFrame) -> DataFrame:
    """The state of the own queue of each GPU arrival; a queue that nobody has changed is empty."""
    return found.filter("kind = 1").select("session_id", "tid", "ts_ns", "queue", "len", "status")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's progress reports as dropped behind the watermark."""
    operators = [s for p in query.recentProgress for s in p["stateOperators"]]
    return sum(s["numRowsDroppedByWatermark"] for s in operators)
