"""Ordered per-key computations (running sums, last known values, replays, lags).

A window over one key sorts all rows of the key in one task. That is the best plan while every key
is small, and the wrong one when a key holds a third of the data. ``ScanPlan.measure`` counts the
rows per key once and picks one of three ways, all with the same result:

``whole``  every key fits one task: plain window functions.
``time``   some keys are too large (hot): each of them is cut into slices of equal time width, by its
           own first and last time; the row counts of the slices are checked. Windows run per (key,
           slice); only the state at the end of each slice crosses slices. Rows of equal time share a
           slice. Other keys are one slice.
``range``  a time slice would still be too large (a burst, or many rows at one instant): rows are
           range-partitioned on (key, order), and each range is a slice.

In the last two ways the end-of-slice states form a small table (one row per key and slice), a
window over it gives the state on entry to each slice, and a join brings that back. ``split`` tells
the rows of hot keys from the others, so that a job of many steps need slice the hot ones only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuescope.session import cut_lineage

SLICE = "__slice"
_ENDS = "__ends"
_LAST = "__last"
_BEFORE = Window.unboundedPreceding


@dataclass(frozen=True)
class Limits:
    """Sizes that decide how keys are cut. Settable as ``spark.queuescope.*``."""

    group_rows: int = 200_000
    slice_rows: int = 50_000

    @classmethod
    def of(cls, spark: SparkSession) -> Limits:
        def read(name: str, default: int) -> int:
            return int(spark.conf.get(f"spark.queuescope.{name}", str(default)))

        return cls(
            group_rows=read("groupRows", cls.group_rows),
            slice_rows=read("sliceRows", cls.slice_rows),
        )


class RunningSum:
    """Sum of ``value`` over all rows up to and including this one; NULL counts as 0."""

    depth = 1

    def __init__(self, value: Column):
        self.value = F.coalesce(value, F.lit(0))

    def local(self, name, window):
        rows = window.rowsBetween(_BEFORE, 0)
        return [{f"__{name}_sum": F.sum(self.value).over(rows)}]

    def carry(self, name, earlier, through, everything):
        return [{f"__{name}_in": F.sum(f"__{name}_sum").over(earlier)}]

    def state(self, name):
        return [f"__{name}_sum"]

    def result(self, name, sliced):
        total = F.col(f"__{name}_sum")
        if sliced:
            total = total + F.coalesce(F.col(f"__{name}_in"), F.lit(0))
        return {name: total}


def position() -> RunningSum:
    """1-based row number."""
    return RunningSum(F.lit(1).cast("bigint"))


class LastKnown:
    """Last non-NULL ``value`` up to this row; ``<name>_before`` leaves this row out."""

    depth = 1

    def __init__(self, value: Column, before: bool = False):
        self.value = value
        self.before = before

    def local(self, name, window):
        cols = {
            f"__{name}_at": F.last(self.value, ignorenulls=True).over(
                window.rowsBetween(_BEFORE, 0)
            )
        }
        if self.before:
            cols[f"__{name}_pre"] = F.last(self.value, ignorenulls=True).over(
                window.rowsBetween(_BEFORE, -1)
            )
        return [cols]

    def carry(self, name, earlier, through, everything):
        return [{f"__{name}_in": F.last(f"__{name}_at", ignorenulls=True).over(earlier)}]

    def state(self, name):
        return [f"__{name}_at"]

    def result(self, name, sliced):
        def entered(column):
            if sliced:
                return F.coalesce(F.col(column), F.col(f"__{name}_in"))
            return F.col(column)

        out = {name: entered(f"__{name}_at")}
        if self.before:
            out[f"{name}_before"] = entered(f"__{name}_pre")
        return out


class Replay:
    """A counter that is set to ``set_to`` where that is not NULL and moves by ``step`` elsewhere.

    The value at a row is the last set value plus the steps after it; NULL before the first set.
    ``backfill`` extends the first set value backwards: value = first set value minus the steps
    that lie between. ``before`` adds ``<name>_before``, the value on arrival at this row.

    With ``c`` the running sum of all steps, ``set_to - c`` is constant between two sets, so the
    value is ``c`` plus the last such difference. No loop over rows is needed.
    """

    depth = 1

    def __init__(self, set_to: Column, step: Column, backfill=False, before=False):
        self.set_to = set_to
        self.step = F.coalesce(step, F.lit(0))
        self.backfill = backfill
        self.before = before

    def local(self, name, window):
        rows = window.rowsBetween(_BEFORE, 0)
        moved = F.col(f"__{name}_moved")
        first = {f"__{name}_moved": F.sum(self.step).over(rows)}
        base = F.when(self.set_to.isNotNull(), self.set_to - moved)
        second = {f"__{name}_base": F.last(base, ignorenulls=True).over(rows)}
        if self.before:
            second[f"__{name}_base_pre"] = F.last(base, ignorenulls=True).over(
                window.rowsBetween(_BEFORE, -1)
            )
            second[f"__{name}_moved_pre"] = moved - self.step
        if self.backfill:
            second[f"__{name}_first"] = F.first(base, ignorenulls=True).over(
                window.rowsBetween(_BEFORE, Window.unboundedFollowing)
            )
        return [first, second]

    def carry(self, name, earlier, through, everything):
        moved, moved_in = f"__{name}_moved", f"__{name}_moved_in"
        first = {moved_in: F.coalesce(F.sum(moved).over(earlier), F.lit(0))}
        # Differences of a slice count its own steps only; counted from the start they are smaller
        # by the steps of all slices before it.
        second = {
            f"__{name}_base_in": F.last(
                F.col(f"__{name}_base") - F.col(moved_in), ignorenulls=True
            ).over(earlier)
        }
        if self.backfill:
            second[f"__{name}_first_all"] = F.first(
                F.col(f"__{name}_first") - F.col(moved_in), ignorenulls=True
            ).over(everything)
        return [first, second]

    def state(self, name):
        cols = [f"__{name}_moved", f"__{name}_base"]
        return cols + ([f"__{name}_first"] if self.backfill else [])

    def result(self, name, sliced):
        def value(moved, base):
            moved, base = F.col(moved), F.col(base)
            if not sliced:
                return moved + base
            entered = F.col(f"__{name}_moved_in") + F.col(f"__{name}_base_in")
            return F.coalesce(moved + base, moved + entered)

        at = value(f"__{name}_moved", f"__{name}_base")
        if self.backfill and sliced:
            counted = F.col(f"__{name}_moved") + F.col(f"__{name}_moved_in")
            at = F.coalesce(at, counted + F.col(f"__{name}_first_all"))
        elif self.backfill:
            at = F.coalesce(at, F.col(f"__{name}_moved") + F.col(f"__{name}_first"))
        out = {name: at}
        if self.before:
            out[f"{name}_before"] = value(f"__{name}_moved_pre", f"__{name}_base_pre")
        return out


class Lag:
    """Values of the rows ``offsets`` places earlier, as ``<value name>_lag_<offset>``."""

    def __init__(self, values: dict[str, Column], offsets: Iterable[int]):
        self.values = values
        self.offsets = sorted(set(offsets))
        if self.offsets and self.offsets[0] < 1:
            raise ValueError("lag offsets must be positive")
        self.depth = max(self.offsets, default=1)

    def local(self, name, window):
        cols = {
            f"__{name}_{key}_{k}": F.lag(value, k).over(window)
            for key, value in self.values.items()
            for k in self.offsets
        }
        cols[f"__{name}_row"] = F.row_number().over(window)
        for key, value in self.values.items():
            cols[f"__{name}_{key}"] = value
        return [cols]

    def carry(self, name, earlier, through, everything):
        # Every slice in the table has at least one row of the key, so the rows needed lie in the
        # ends of the ``depth`` slices before.
        near = through.rowsBetween(-self.depth, -1)
        rows = F.flatten(F.collect_list(_ENDS).over(near))
        first = F.greatest(F.size(rows) - F.lit(self.depth - 1), F.lit(1))
        return [{f"__{name}_in": F.slice(rows, first, self.depth)}]

    def state(self, name):
        return [f"__{name}_{key}" for key in self.values]

    def result(self, name, sliced):
        out = {}
        row = F.col(f"__{name}_row")
        for key in self.values:
            for k in self.offsets:
                own = F.col(f"__{name}_{key}_{k}")
                if sliced:
                    back = F.least(row - F.lit(k + 1), F.lit(-1))
                    entered = F.try_element_at(F.col(f"__{name}_in"), back)
                    own = F.when(row > k, own).otherwise(entered[f"__{name}_{key}"])
                out[f"{key}_lag_{k}"] = own
        return out


#: Hot keys that are sent to every task; a longer list is joined by a shuffle.
HOT_KEYS = 10_000
#: Slices that a task takes on average, so that its rows do not grow with the table.
TASK_SLICES = 4
#: Ranges are cut finer than ``Limits.slice_rows`` by default says only up to this number. A task each, they
#: report to the driver, so their number must not follow a tiny limit.
MOST_RANGES = 1_000


@dataclass(frozen=True)
class ScanPlan:
    """How ordered computations are spread over tasks. Made by :meth:`measure`."""

    mode: str = "whole"
    slices: int = 1
    keys: tuple[str, ...] = ()
    #: ``__hot_<i>`` for each of the keys, ``__origin`` and ``__width`` of the key's time slices.
    hot: DataFrame | None = None

    @classmethod
    def measure(
        cls,
        df: DataFrame,
        keys: Sequence[str] = (),
        time: str | None = None,
        limits: Limits | None = None,
        slack: int = 1,
    ) -> ScanPlan:
        """Count rows per key (a partial aggregate, one row back) and choose the way.

        The plan also holds for every finer key, and for any rows whose number per key and time is
        at most ``slack`` times that of ``df``.
        """
        limits = limits or Limits.of(df.sparkSession)
        group_rows = max(1, limits.group_rows // slack)
        slice_rows = max(1, limits.slice_rows // slack)
        bounds = [F.min(time).alias("__lo"), F.max(time).alias("__hi")] if time else []
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *bounds)
        seen = sizes.agg(F.max("__n").alias("largest"), F.sum("__n").alias("total")).first()
        if not seen.largest or seen.largest <= group_rows:
            return cls()
        # A key without a time, if there is one, has no slices but ranges.
        named = [F.col(k).alias(f"__hot_{i}") for i, k in enumerate(keys)]
        width = F.lit(1).cast("bigint")
        if time:
            parts = F.ceil(F.col("__n") / slice_rows)
            width = F.greatest(F.ceil((F.col("__hi") - F.col("__lo") + 1) / parts), F.lit(1)).cast("bigint")
        origin = F.col("__lo") if time else F.lit(0).cast("bigint")
        hot = sizes.filter(F.col("__n") > group_rows).select(*named, origin.alias("__origin"), width.alias("__width"))
        hot = _few_or_stored(hot)
        by_range = cls("range", range_count(seen.total, slice_rows), tuple(keys), hot)
        if time is None or not keys:
            return by_range
        by_time = cls("time", max(2, math.ceil(seen.total / slice_rows)), tuple(keys), hot)
        fullest = by_time.sliced(df, time).groupBy(*keys, SLICE).count().agg(F.max("count").alias("n")).first()
        return by_time if fullest.n <= group_rows else by_range

    @property
    def is_whole(self) -> bool:
        return self.mode == "whole"

    def _is_hot(self, df: DataFrame) -> Column:
        match = F.lit(True)
        for i, k in enumerate(self.keys):
            match = match & df[k].eqNullSafe(self.hot[f"__hot_{i}"])
        return match

    def sliced(self, df: DataFrame, time: str) -> DataFrame:
        """Add the number of the time slice; 0 for keys that are not hot."""
        joined = df.join(self.hot, self._is_hot(df), "left")
        number = F.call_function("div", F.col(time) - F.col("__origin"), F.col("__width"))
        return joined.withColumn(SLICE, F.coalesce(number, F.lit(0))).select(*df.columns, SLICE)

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of the keys that fit one task, and rows of the hot ones."""
        return df.join(self.hot, self._is_hot(df), "left_anti"), df.join(self.hot, self._is_hot(df), "left_semi")

    def co_locate(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """One exchange that serves all later windows on ``keys`` and finer keys."""
        return df.repartition(*keys) if self.is_whole else df

    def spread(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Rows by ``keys`` in as many tasks as the time slices need; a fixed number, so that none are merged."""
        if self.mode != "time":
            return df
        return df.repartition(max(2, math.ceil(self.slices / TASK_SLICES)), *keys)

    def compute(
        self, df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str | None = None, **ops
    ) -> DataFrame:
        """Add the results of ``ops`` (name -> operation) to ``df``.

        ``order`` must be a total order within ``keys`` wherever it matters for the result. ``time``
        names the first order column where slices by time may be used.
        """
        return self.compute_all(df, [(keys, ops)], order, time)

    def compute_all(
        self,
        df: DataFrame,
        passes: Sequence[tuple[Sequence[str], dict]],
        order: Sequence[str],
        time: str | None = None,
    ) -> DataFrame:
        """Like ``compute`` for several (keys, operations) of one order; the rows are stored once.

        The keys of each are those that were measured or finer ones.
        """
        kept = df.columns
        every = {name: op for _, ops in passes for name, op in ops.items()}
        if self.is_whole:
            for keys, ops in passes:
                df = _add_local(df, ops, Window.partitionBy(*keys).orderBy(*order))
            return _select_results(df, kept, every, sliced=False)
        if self.mode == "time" and time is not None:
            coarse = self.keys if all(set(self.keys) <= set(k) for k, _ in passes) else passes[0][0]
            local = self.spread(self.sliced(df, time), [*coarse, SLICE])
        else:
            # Ranges in the order of the coarsest keys are in order for the finer ones too.
            coarse = passes[0][0] if len(passes) == 1 else self.keys
            local = df.repartitionByRange(max(self.slices, 2), *coarse, *order).withColumn(
                SLICE, F.spark_partition_id().cast("bigint")
            )
        for i, (keys, ops) in enumerate(passes):
            window = Window.partitionBy(*keys, SLICE).orderBy(*order)
            depth = max(op.depth for op in ops.values())
            local = _add_local(local, ops, window).withColumn(
                f"{_LAST}_{i}", F.lead(F.lit(1), depth).over(window).isNull()
            )
        # Both the end-of-slice tables and the rows themselves are read from here.
        local = cut_lineage(local)
        ends = local
        if len(passes) > 1:  # the few rows that end a slice of any pass, so that not every pass reads all rows
            ends = cut_lineage(local.filter(" or ".join(f"{_LAST}_{i}" for i in range(len(passes)))))
        out = local
        for i, (keys, ops) in enumerate(passes):
            carried = _carry(ends.filter(f"{_LAST}_{i}"), keys, order, ops, f"__key_{i}")
            out = _join_carry(out, carried, keys, f"__key_{i}")
        return _select_results(out, kept, every, sliced=True)


def range_count(rows: int, slice_rows: int) -> int:
    """Ranges of ``slice_rows`` rows; above ``MOST_RANGES`` of them, ranges of the default size if that is larger."""
    wanted = math.ceil(rows / slice_rows)
    usual = math.ceil(rows / max(slice_rows, Limits.slice_rows))
    return max(2, min(wanted, max(MOST_RANGES, usual)))


def _few_or_stored(hot: DataFrame) -> DataFrame:
    """A bounded list of hot keys is broadcast; a longer one is stored."""
    rows = hot.limit(HOT_KEYS + 1).toArrow()
    if rows.num_rows <= HOT_KEYS:
        return F.broadcast(hot.sparkSession.createDataFrame(rows, hot.schema))
    return cut_lineage(hot)


def _add_local(df, ops, window):
    passes = [op.local(name, window) for name, op in ops.items()]
    for level in range(max(len(p) for p in passes)):
        cols = {}
        for p in passes:
            if level < len(p):
                cols.update(p[level])
        df = df.withColumns(cols)
    return df


def _carry(ends, keys, order, ops, prefix):
    """State on entry to each slice, from the last rows of the slices before it."""
    states = [c for name, op in ops.items() for c in op.state(name)]
    ends = ends.groupBy(*keys, SLICE).agg(
        F.sort_array(F.collect_list(F.struct(*order, *states))).alias(_ENDS)
    )
    last = F.element_at(_ENDS, -1)
    ends = ends.select(*keys, SLICE, _ENDS, *[last[c].alias(c) for c in states])
    through = Window.partitionBy(*keys).orderBy(SLICE)
    earlier = through.rowsBetween(_BEFORE, -1)
    everything = through.rowsBetween(_BEFORE, Window.unboundedFollowing)
    passes = [op.carry(name, earlier, through, everything) for name, op in ops.items()]
    names = []
    for level in range(max(len(p) for p in passes)):
        cols = {}
        for p in passes:
            if level < len(p):
                cols.update(p[level])
        ends = ends.withColumns(cols)
        names += cols
    renamed = [F.col(k).alias(f"{prefix}_{i}") for i, k in enumerate([*keys, SLICE])]
    return ends.select(*renamed, *names)


def _join_carry(local, carried, keys, prefix):
    match = F.lit(True)
    for i, k in enumerate([*keys, SLICE]):
        match = match & local[k].eqNullSafe(carried[f"{prefix}_{i}"])
    return local.join(carried, match, "left")


def _select_results(df, kept, ops, sliced):
    results = {}
    for name, op in ops.items():
        results.update(op.result(name, sliced))
    return df.select(
        *[c for c in kept if c not in results],
        *[value.alias(name) for name, value in results.items()],
    )
