import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from queuescope.llm import lm
from tests.llm.words import thue_morse


def plain(texts, order=2):
    docs = [[w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w] for t in texts]
    grams = lambda d: Counter(tuple(d[k : k + n]) for n in range(1, order + 1) for k in range(len(d) - n + 1))
    everything, total, out = sum(map(grams, docs), Counter()), sum(map(len, docs)), []
    for d in docs:
        own = grams(d)
        left = lambda g: everything[g] - own[g]  # noqa: B023, E731
        score, backoff, unseen = 0.0, 0, 0
        for k, w in enumerate(d):
            unseen += left((w,)) == 0
            share = max(left((w,)), 0.5) / max(total - len(d), 1)
            for n in range(2, min(order, k + 1) + 1):
                gram = tuple(d[k - n + 1 : k + 1])
                share = left(gram) / left(gram[:-1]) if left(gram) else 0.4 * share
            backoff += k > 0 and not left(tuple(d[max(0, k - order + 1) : k + 1]))
            score += math.log(share)
        out.append((len(d), backoff, unseen, score))
    return out


@pytest.mark.parametrize(("size", "order"), [(500, 2), (16_000_000, 2), (700, 3), (16_000_000, 5), (700, 1)])
def test_matches_brute_force(spark, monkeypatch, size, order):
    monkeypatch.setattr(lm, "CHUNK_BYTES", size)
    monkeypatch.setattr(lm, "BUCKET_NGRAMS", 300)
    rng = random.Random(1)
    words = ["The", "the", "é", "日本", "a.", *[f"w{k}" for k in range(60)]]
    texts = [rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "once", "once", texts[4], texts[4], "the " * 5000]
    rows = [(k if k % 9 else None, t, 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, chunk int").repartition(3)
    want = plain(texts, order)
    got = lm.backoff_scores(docs, order=order).collect()
    key = lambda r: (str(r[0]), *r[1:4], round(r[4], 6) + 0.0)
    have = [key((r.doc_id, r.n_words, r.n_backoff, r.n_unseen, r.log_score)) for r in got]
    assert sorted(have) == sorted(key((i, *w)) for (i, _, _), w in zip(rows, want, strict=True))


def test_empty_table_and_single_document(spark):
    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    assert lm.backoff_scores(docs.limit(0)).collect() == []
    row = lm.backoff_scores(docs).first()
    assert (row.n_words, row.n_backoff, row.n_unseen) == (3, 2, 3) and math.isfinite(row.log_score)


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        values = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
        assert (lm._unpack_hashes(lm._pack_hashes(values)) == values).all()
        for top in (200, 2**40):
            counts = rng.integers(0, top, n)
            assert (lm._unpack_counts(lm._pack_counts(counts)) == counts).all()


def test_words_of_one_polynomial_hash(spark):
    texts = [" ".join(t) for size in (512, 2048) for w, o in [thue_morse(size)] for t in ((w, "x"), (o, "y"), (w, "x", "y"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_backoff, r.n_unseen, round(r.log_score, 9)) for r in lm.backoff_scores(docs).collect()}
    assert got == {k: (n, b, u, round(s, 9)) for k, (n, b, u, s) in enumerate(plain(texts))}
