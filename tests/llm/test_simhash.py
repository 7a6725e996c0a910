import random

import pytest
import xxhash

from queuescope.llm import simhash

SCHEMA = "source string, doc_id long, text string, row_ string, fp int"


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = [None, "", " \t\n", "one", "One", "two Words", "x y a b c d", "w " * 70000]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(rng.choice([" ", "\n"]).join(copy).title())
    return out


def test_components_match_brute_force(spark, texts):
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    docs = spark.createDataFrame([("s", i, t, "r", None) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_components(docs).collect()}
    by_id = sorted(zip(ids, texts, strict=True))
    prints = [plain_fingerprint(t) for _, t in by_id]
    assert {i: f"{p:016x}" for (i, _), p in zip(by_id, prints, strict=True)} == {i: v[0] for i, v in got.items()}
    roots = plain_components(prints)
    assert {i: r for (i, _), r in zip(by_id, roots, strict=True)} == {i: v[1] for i, v in got.items()}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))


def test_links_reach_all_pairs_in_long_and_short_runs():
    import numpy as np

    rng = np.random.default_rng(3)
    near = rng.integers(0, 2**63, 1, dtype=np.uint64)[0]
    ball = [near]
    for _ in range(400):
        value = int(ball[rng.integers(len(ball))])
        for bit in rng.integers(0, 64, rng.integers(1, 7)):
            value ^= 1 << int(bit)
        ball.append(np.uint64(value))
    values = np.unique(np.array(ball + rng.integers(0, 2**63, 500, dtype=np.uint64).tolist(), np.uint64))
    index = {int(v): i for i, v in enumerate(values)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for segment, kept in simhash.variants(4):
        for a, b in zip(*simhash.links_of(values, segment, kept, 4), strict=True):
            assert int(a) != int(b)
            i, j = find(index[int(a)]), find(index[int(b)])
            root[max(i, j)] = min(i, j)
    assert [find(i) for i in range(len(values))] == plain_components([int(v) for v in values])


def test_chain_of_components(spark):
    from queuescope.llm.common import Scratch

    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)]
    stars = simhash.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    got = {r.node: r.root for r in stars.collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + k: 1000 for k in range(300)}


def test_odd_rows(spark):
    rows = [("a", None, "same text here now", None, 1), ("b", 3, "same text here now", None, 2)]
    rows += [("c", 3, "same text here now", None, 2), ("d", None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_components(docs).collect())
    assert got == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    kept = simhash.drop_near_copies(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("3", "same text here now"), ("None", None)], key=str)
    assert simhash.near_components(docs.limit(0)).collect() == []
    assert simhash.drop_near_copies(docs.limit(0)).collect() == []
