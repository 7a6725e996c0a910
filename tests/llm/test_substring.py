import random
import re

import numpy as np
import pytest

from queuescope.llm import substring
from tests.llm.words import thue_morse


def plain(rows, window):
    """``rows`` in the order that decides which window is first."""
    seen, out = set(), {}
    for place, (_, text) in enumerate(rows):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        gone = set()
        for i in range(len(words) - window + 1):
            seq = tuple(words[i : i + window])
            if seq in seen:
                gone.update(range(i, i + window))
            seen.add(seq)
        out[place] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def sample(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["ünï", "日本", " "]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 90))] for _ in range(8)]
    out = []
    for _ in range(80):
        text = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 5)
                text += p[a : len(p) - rng.randint(0, 5)]
            text += [rng.choice(words) for _ in range(rng.randint(0, 60))]
        out.append(rng.choice([" ", "\n", " \t"]).join(text))
    out += [out[3], out[3], out[5] + " " + out[5], "a " * 500, "a " * 300, "", None, "a b c"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "window"), [(1, 20), (2, 7)])
def test_matches_brute_force(spark, monkeypatch, seed, window):
    monkeypatch.setattr(substring, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(substring, "BUCKET_HASHES", 2000)
    texts = sample(seed)
    ids = random.Random(seed).sample(range(-5000, 5000), len(texts))
    rows = sorted(zip(ids, texts, strict=True))
    frame = spark.createDataFrame([(t, "x", i, 1) for i, t in zip(ids, texts, strict=True)], "text string, chunk string, doc_id long, size int")
    want = plain(rows, window)
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.removed), r.kept) for r in substring.remove_repeats(frame.repartition(3), window).collect()}
    assert got == {rows[k][0]: v for k, v in want.items()}
    assert sum(v[1] for v in want.values()) > 1000


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (7, text), (7, text), (None, None), (8, text + " more"), (None, text)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((str(r.doc_id), r.n_words, len(r.kept.split())) for r in substring.remove_repeats(frame).collect())
    assert got == [("7", 30, 0), ("7", 30, 30), ("8", 31, 1), ("None", 0, 0), ("None", 30, 0), ("None", 30, 0)]
    assert substring.remove_repeats(frame.limit(0)).collect() == []


def test_sorted_numbers_round_trip():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 20, 1 << 40, 1 << 61):
        values = np.unique(rng.integers(0, top, 500, dtype=np.uint64))
        assert (substring._unpack_sorted(substring._pack_sorted(values)) == values).all()
    assert len(substring._unpack_sorted(substring._pack_sorted(np.zeros(0, np.uint64)))) == 0


def test_words_of_one_polynomial_hash(spark):
    for size in (512, 2048):
        word, other = thue_morse(size)
        around = [f"w{k}" for k in range(19)]
        rows = [(1, " ".join([word, *around])), (2, " ".join([other, *around])), (3, " ".join([other, *around]))]
        got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.kept for r in got} == {1: rows[0][1], 2: rows[1][1], 3: ""}
