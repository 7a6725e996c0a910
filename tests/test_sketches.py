"""Sketches and samples against sorted values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuescope.operators import sketches as K
from queuescope.operators import stats as S

PROBS = [0.0, 0.001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = [("hot", "s%d" % (i % 7), rng.lognormvariate(0, 2)) for i in range(40_000)]
    rows += [("tied", "s1", 4.0)] * 3000 + [("tied", "s2", float(k)) for k in range(500)]
    rows += [("one", "s1", -3.5), ("none", "s1", None), ("odd", "s1", float("nan")), ("odd", "s2", 1.0)]
    return spark.createDataFrame(rows, "k string, s string, v double").repartition(6).cache()


def ranks_are_right(values, found, error):
    values = np.sort(values)
    for p, q in zip(PROBS, found, strict=True):
        low, high = (np.searchsorted(values, q, side) / len(values) for side in ("left", "right"))
        assert low - error <= p <= high + error, (p, q)


@pytest.mark.parametrize("error", [0.05, 0.005])
def test_ranks_within_the_error(table, error):
    rows = [r for r in table.collect() if r.v is not None and not np.isnan(r.v)]
    found = {r.k: r for r in S.quantiles(table, ["k"], "v", PROBS, error=error).collect()}
    assert set(found) == {r.k for r in rows}
    merged = K.merge_sketches(K.quantile_sketches(table, ["k", "s"], "v", error), ["k"])
    merged = {r.k: r for r in K.sketch_quantiles(merged, ["k"], PROBS).collect()}
    for k, r in found.items():
        values = [x.v for x in rows if x.k == k]
        assert r.n == merged[k].n == len(values)
        ranks_are_right(values, r.quantiles, error)
        ranks_are_right(values, merged[k].quantiles, error)


def test_sketches_stay_small(table):
    sizes = K.quantile_sketches(table, ["k"], "v", 0.01).select(F.length("sketch")).collect()
    assert max(r[0] for r in sizes) < 20_000


def test_rank_gaps_see_a_wrong_quantile(spark):
    rows = spark.createDataFrame([("a", float(k)) for k in range(100)], "k string, v double")
    wrong = spark.createDataFrame([("a", [24.0, 70.0])], "k string, quantiles array<double>")
    (r,) = K.rank_gaps(rows, ["k"], "v", wrong, [0.25, 0.5]).collect()
    assert r.gaps == pytest.approx([0.0, 0.2])


def test_describe_and_box_with_an_error(table):
    exact = S.describe(table.filter("k = 'hot'"), "v").first()
    rough = S.describe(table.filter("k = 'hot'"), "v", error=0.01).first()
    for c in ("count", "min", "max"):
        assert rough[c] == exact[c]
    assert rough.mean == pytest.approx(exact["mean"]) and rough["std"] == pytest.approx(exact["std"])
    assert S.describe(table.filter("k = 'none'"), "v", error=0.01).first()["q50"] is None
    boxes = {r.k: r for r in S.box_summary(table.filter("k <> 'odd'"), ["k"], "v", error=0.001).collect()}
    assert boxes["tied"].q50 == 4.0 and boxes["one"].outliers == 0
    values = [r.v for r in table.filter("k = 'hot'").collect()]
    b = boxes["hot"]
    reach = 1.5 * (b.q75 - b.q25)
    inside = [v for v in values if b.q25 - reach <= v <= b.q75 + reach]
    assert (b.whisker_low, b.whisker_high, b.outliers) == (min(inside), max(inside), len(values) - len(inside))


@pytest.mark.parametrize("error", [0, 1, 1e-6])
def test_errors_that_no_sketch_can_keep(error):
    with pytest.raises(ValueError):
        K.sketch_size(error)


@pytest.mark.parametrize("points", [1, 4, 40])
def test_reduced_series_keeps_extremes(spark, points):
    rng = random.Random(2)
    rows = [(s, rng.randrange(10_000), k, rng.choice([None, *range(30)]), f"t{k}") for k in range(3000) for s in ([0] if k % 3 else [1, None])]
    rows += [(7, 5, 1, 2, "alone"), (8, None, 1, 2, "no time"), (9, -(1 << 62), 1, 1, "far"), (9, 1 << 62, 2, 1, "far")]
    frame = spark.createDataFrame(rows, "session_id long, ts_ns long, seq long, v int, tid string").repartition(5)
    got = K.reduced_series(frame, "v", points).collect()
    assert all(tuple(r) in set(rows) for r in got) and len(set(got)) == len(got)
    for s in (0, 1, 7, 9):
        own = [r for r in rows if r[0] == s and r[1] is not None and r[3] is not None]
        kept = [r for r in got if r.session_id == s]
        assert 0 < len(kept) <= max(4, points)
        assert min(r.v for r in kept) == min(r[3] for r in own) and max(r.v for r in kept) == max(r[3] for r in own)
        order = lambda r: (r[1], r[2])
        assert tuple(min(kept, key=order)) == min(own, key=order) and tuple(max(kept, key=order)) == max(own, key=order)


def test_samples_are_mergeable(spark):
    rows = [(k % 3, f"t{k}", float(k)) for k in range(900)] + [(5, None, 1.0), (5, "t", 2.0), (None, "x", 3.0)]
    frame = spark.createDataFrame(rows, "session_id int, tid string, v double")
    whole = {tuple(r) for r in K.sampled_points(frame, 20, ["session_id", "tid"]).collect()}
    assert len(whole) == 63
    halves = [K.sampled_points(frame.filter(c), 20, ["session_id", "tid"]) for c in ("v < 300", "v >= 300")]
    again = K.sampled_points(halves[0].union(halves[1]), 20, ["session_id", "tid"])
    assert {tuple(r) for r in again.collect()} == whole
