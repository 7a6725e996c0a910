import random
import re

import numpy as np
import pyarrow as pa

from queuescope.llm import decontam
from tests.llm.words import thue_morse

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window):
    own, hit, named = words(text), set(), set()
    for name, item in items:
        seq = words(item)
        size = min(window, len(seq))
        phrases = {tuple(seq[i : i + size]) for i in range(len(seq) - size + 1)} if size else set()
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in phrases:
                hit.update(range(i, i + size))
                named.add(name)
    return len(own), sorted(hit), sorted(x for x in named if x is not None)


def rows_of(frame):
    out = {}
    for r in frame.collect():
        out[r.doc_id] = (r.n_words, [k for s in r.spans for k in range(s.start, s.end)], r["items"])
    return out


def sample(seed, vocabulary=6):
    rng = random.Random(seed)
    bank = ["Ab", "ß9", "x", "éa", "the", "of", "zz", "日本", "q1"][:vocabulary]
    items = [(str(k), " ".join(rng.choice(bank) for _ in range(rng.randint(1, 9)))) for k in range(12)]
    items += [(None, "the of the"), ("e", ""), ("n", None), ("p", "...!"), ("0", items[1][1])]
    docs = [(k, rng.choice([" ", "-", "\n", "!? "]).join(rng.choice([*bank, "other"]) for _ in range(rng.randint(0, 80)))) for k in range(60)]
    docs += [(60, None), (61, ""), (62, "..."), (63, "the of " * 3000), (None, "the of the")]
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_BYTES", 900)
    monkeypatch.setattr(decontam, "LOCATE", 500)
    for seed in (1, 2):
        docs, items = sample(seed)
        frame = spark.createDataFrame([("s", i, t, 3) for i, t in docs], "found string, doc_id long, text string, doc int")
        bench = spark.createDataFrame(items, "item_id string, text string")
        got = rows_of(decontam.contamination(frame, bench, window=5))
        assert got == {i: plain(t, items, 5) for i, t in docs}
        kept = decontam.drop_contaminated(frame, bench, window=5)
        assert kept.columns == frame.columns
        clean = [i for i, t in docs if not got[i][1] or 20 * len(got[i][1]) < got[i][0]]
        assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(map(str, clean))


def test_blocks_of_items_add_up(spark, monkeypatch):
    docs, items = sample(3)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 40)
    monkeypatch.setattr(decontam, "CHAIN", 2)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert rows_of(decontam.contamination(frame, bench, window=5)) == {i: plain(t, items, 5) for i, t in docs}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(decontam.contamination(docs, none)) == {1: (2, [], []), 2: (0, [], [])}
    assert decontam.contamination(docs.limit(0), none).collect() == []
    assert decontam.drop_contaminated(docs, none).count() == 2


def test_index_counts_and_locates():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 5000)
    text[-1] = 0
    text[1000:1400] = text[:400]
    index = decontam.FmIndex(text, 4)
    for size in (1, 2, 5, 9):
        starts = rng.integers(0, 4980, 200)
        phrases = np.stack([text[s : s + size] for s in starts])
        phrases = np.unique(phrases[(phrases > 0).all(axis=1)], axis=0)
        low, high = index.search(phrases.astype(np.int32))
        for phrase, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == phrase).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    texts = pa.array(["Aa b", None, "b aA"])
    found = decontam.search_shard(texts, decontam.Phrases.of(["i"], ["AA b"], 13))
    assert found[1].tolist() == [0] and found[2].tolist() == [2] and found[3] == [["i"], [], []]


def test_words_of_one_polynomial_hash(spark):
    for size in (512, 2048):
        word, other = thue_morse(size)
        docs = spark.createDataFrame([(1, f"so {word} it is"), (2, f"so {other} it is")], "doc_id long, text string")
        bench = spark.createDataFrame([("a", word), ("b", f"x {other}")], "item_id string, text string")
        assert rows_of(decontam.contamination(docs, bench)) == {1: (4, [1], ["a"]), 2: (4, [], [])}


def test_alphabet_of_words_with_one_hash(monkeypatch):
    """Hashes of a first seed that all collide: words are still told apart, by another seed or by bytes."""
    plain_hash = decontam.hash_words
    monkeypatch.setattr(decontam, "hash_words", lambda d, b, e, seed=1: plain_hash(d, b, e, seed) & np.uint64(0 if seed < 3 else 7))
    phrases = decontam.Phrases.of(["i"], ["the cat"], 13)
    assert phrases.alphabet.seed >= 3
    _, start, end, items = decontam.search_shard(pa.array(["a dog and the cat or cats", "cat the"]), phrases)
    assert (start.tolist(), end.tolist(), items) == ([3], [5], [["i"], []])
