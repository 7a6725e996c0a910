import hashlib
import random

import pytest

from queuescope.llm import exact

BLANKS = {k: None for k in (0x20, *range(9, 14))}


def plain(rows):
    """``rows``: (id, text) in table order."""
    groups = {}
    for place, (id_, text) in enumerate(rows):
        groups.setdefault((text or "").translate(BLANKS), []).append((-len(text or ""), id_ is None, id_ or 0, place))
    out = []
    for text, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(None if no else i, keep, len(members), m == best, sha) for m in members for _, no, i, _ in [m]]
    return sorted(out, key=str)


@pytest.mark.parametrize("fan_bits", [1, 4])
def test_matches_brute_force(spark, monkeypatch, fan_bits):
    monkeypatch.setattr(exact, "FAN_BITS", fan_bits)
    rng = random.Random(2)
    texts = [None, "", " \n", "a b", "ab", "a  b", "A b", "é  ", "é ", "日 本", "x" * 100_000]
    rows = [(k if k % 13 else None, rng.choice(texts) if rng.random() < 0.6 else f"t {k % 90}") for k in range(400)]
    rows += rows[:20] + [(7, "hot one")] * 300
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id int, text string, row_ int, run string").coalesce(1)
    from pyspark.sql import functions as F

    frame = frame.repartitionByRange(11, F.monotonically_increasing_id())
    got = exact.exact_groups(frame).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=str) == plain(rows)
    kept = exact.drop_copies(frame)
    assert kept.columns == frame.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([r[0] for r in plain(rows) if r[3]], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_groups(docs).collect() == []
    assert exact.drop_copies(docs).collect() == []
