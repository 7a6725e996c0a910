import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuescope.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, row int, vector string"


def plain(rows):
    used = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        used.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for a, (anchor, label, q) in enumerate(used):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(q, v)), i, l, k) for k, (i, l, v) in enumerate(used) if k != a]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for ps, positive, *_ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps][:5]
            out += [(anchor, positive, k + 1, i, ps, s) for k, (s, i, *_) in enumerate(fits)]
    return sorted(out, key=str)


def rows_of(frame):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted([tuple(r[c] for c in names) for r in frame.collect()], key=str)


def corpus(n, dims, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, dims))
    rows = []
    for k in range(n):
        v = centres[rng.integers(6)] + spread * rng.normal(size=dims)
        rows.append((k * 5, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(4))))
    return rows


@pytest.mark.parametrize("spread, dims, lanes, block", [(0.3, 8, 4, 37), (1.0, 40, 256, 10_000)])
def test_matches_brute_force(spark, monkeypatch, spread, dims, lanes, block):
    monkeypatch.setattr(negatives, "LANES", lanes)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "STEP", 3)
    monkeypatch.setattr(negatives, "ANCHORS", 9)
    rows = corpus(400, dims, spread)
    rows += [(None, rows[3][1], 1), (8, None, 1), (200_000, [float("nan")] * dims, 2), (300_000, rows[9][1], None), (11, [1.0, None], 2)]
    rows += [(12, [], 1), (13, [0.5], 2), (100_000, [], 3), (17, [math.inf] * dims, 3)]
    rows += rows[:25] + [(500 + 5 * k, rows[20][1], k % 3) for k in range(60)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    assert rows_of(queries.mined_negatives(frame)) == plain(rows)


def test_no_anchor_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert queries.mined_negatives(none).collect() == []
    assert queries.mined_negatives(spark.createDataFrame([(1, [1.0], 1, 1, "x")], SCHEMA)).collect() == []


def test_lists_leave_out_what_the_norms_cover(monkeypatch):
    monkeypatch.setattr(negatives, "STEP", 2)
    rng = random.Random(1)
    vectors = np.array([[rng.randrange(-90, 91) / (1 + d) for d in range(10)] for _ in range(200)])
    q = np.array([[rng.randrange(-90, 91) / (1 + d) for d in range(10)] for _ in range(5)])
    norms, q_norms = negatives.suffix_norms(vectors), negatives.suffix_norms(q)
    exact = q @ vectors.T
    for share in (0.2, 0.6, 0.9):
        least = share * exact.max(axis=1)
        index = negatives.Index(vectors, norms, q_norms.max(axis=0), least.min())
        assert sum(index.listed) < 5 * len(vectors)
        found = set(zip(*index.search(q, q_norms, least, np.ones(exact.shape, bool))))
        assert {(a, r) for a, r in zip(*np.nonzero(exact >= least[:, None]))} <= found


def test_few_positives(spark):
    rows = [(100, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.0], 2), (3, [0.0, 1.0], 2), (4, [-1.0, 0.0], 1)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = negatives.hard_negatives(frame, F.col("id") % 100 == 0)
    assert rows_of(got) == plain(rows) and got.count() == 1
