import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from queuescope.llm import fracsketch


def plain_sketch(text, size=5, fraction=1 / 8):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    hashes = [hashlib.md5(" ".join(words[k : k + size]).encode()).hexdigest() for k in range(max(1, len(words) - size + 1))]
    hashes = hashes if words else []
    low = [h for h in hashes if int(h, 16) < fraction * 16**32]
    return sorted({h[:16] for h in low or sorted(hashes)[:1]})


def like(a, b):
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else float(not a and not b)


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for k, (id_, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new = plain_sketch(text), plain_sketch(edited)
        out.append((id_, len(text), edited, own, new, like(own, new), like(own, plain_sketch(after))))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted([(r.doc_id, r.n_chars, r.edited, r.sketch, r.edited_sketch, r.near_edited, r.near_next) for r in frame.collect()], key=str)


@pytest.mark.parametrize("fan", [4, 256])
def test_matches_brute_force(spark, monkeypatch, fan):
    monkeypatch.setattr(fracsketch, "_FAN", fan)
    rng = random.Random(5)
    words = ["a", "bb", "é", "日本", "Word", "x" * 40]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "\n\t", " "]) for _ in range(rng.choice([0, 1, 4, 30, 90])))
    rows = [(rng.randrange(-500, 500), text()) for _ in range(300)]
    rows += [(None, None), (None, "no id"), (7, None), (7, ""), (7, " "), (7, "🎉" * 9), (1 << 62, "far"), (8, "w " * 50_000)]
    rows += rows[:30] + [(3, "same text of a hot id")] * 200
    frame = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, rank int, guest boolean").repartition(7)
    assert rows_of(fracsketch.fingerprints(frame)) == plain(rows)


def test_single_and_empty(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert rows_of(fracsketch.fingerprints(docs)) == plain([(1, "one two three")])
    assert fracsketch.fingerprints(docs.where("doc_id > 1")).collect() == []


def test_merge_is_the_sketch_of_the_union(spark):
    texts = [" ".join(str(k) for k in range(n, n + size)) for n in (0, 3, 500) for size in (0, 2, 6, 9, 400)]
    frame = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    got = frame.select("a", "b", fracsketch.merged(fracsketch.sketch(F.col("a")), fracsketch.sketch(F.col("b"))).alias("m")).collect()
    for r in got:
        hashes = lambda t: [hashlib.md5(" ".join(t.split()[k : k + 5]).encode()).hexdigest() for k in range(max(1, len(t.split()) - 4))] if t else []
        both = hashes(r.a) + hashes(r.b)
        low = [h for h in both if int(h, 16) < 16**32 / 8] or sorted(both)[:1]
        assert r.m == sorted({h[:16] for h in low})


def test_containment_of_a_passage(spark):
    long = " ".join(str(k) for k in range(4000))
    part = " ".join(str(k) for k in range(1000, 1400))
    row = spark.createDataFrame([(long, part)], "a string, b string").select(
        fracsketch.containment(fracsketch.sketch(F.col("a")), fracsketch.sketch(F.col("b")))
    )
    assert row.first()[0] == 1.0
