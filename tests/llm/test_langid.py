import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from queuescope.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in langid._steps(rng, 3).items()}
    data = rng.integers(0, 256, (6, 4))
    weight = rng.normal(size=(6, 3, 4))

    def loss():
        h, out = np.zeros((3, 4)), 0.0
        for t, column in enumerate(data):
            x = (p["input"] + p["bias"])[:, column]
            g = p["state"] @ h
            gate = 1 / (1 + np.exp(-(x[:6] + g[:6])))
            c = np.tanh(x[6:] + gate[3:] * g[6:])
            h = c + gate[:3] * (h - c)
            out += (h * weight[t]).sum()
        return out

    single = {k: v.astype(np.float32) for k, v in p.items()}
    out, kept = langid._read(single, data, trace=True)
    assert abs((out * weight).sum() - loss()) < 1e-4
    grad = langid._back(single, data, kept, weight.astype(np.float32))
    for name, values in p.items():
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in values.shape)
            if name == "input":
                at = (at[0], data[rng.integers(6), rng.integers(4)])
            old, step = values[at], 1e-4
            values[at] = old + step
            up = loss()
            values[at] = old - step
            slope = (up - loss()) / (2 * step)
            values[at] = old
            assert abs(slope - grad[name][at]) < 1e-3 + 1e-2 * abs(slope)


def test_pooling_reads_every_position():
    network = langid.Network.new(["a", "b"])
    texts = pa.array(["", None, "x" * 64, "héllo " * 50, "z", "q" * 65])
    data, lengths, doc = langid.segments(texts)
    assert lengths.sum() == sum(len((t or "").encode()) for t in texts.to_pylist())
    got = network.pooled(data, lengths, doc, len(texts))
    for k, t in enumerate(texts.to_pylist()):
        raw, want = (t or "").encode(), np.zeros(2)
        for at in range(0, len(raw), langid.SEGMENT):
            piece = np.frombuffer(raw[at : at + langid.SEGMENT].ljust(langid.SEGMENT, b"\0"), np.uint8)[:, None]
            want += network.log_probabilities(piece)[: len(raw[at : at + langid.SEGMENT]), :, 0].sum(axis=0)
        assert np.allclose(got[k], want, rtol=1e-4, atol=1e-4)


@pytest.fixture(scope="module")
def network(spark):
    return queries.language_network(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, network):
    got = langid.identify(spark.read.parquet(f"{SF}/documents.parquet"), network).collect()
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) == 1000 and len(held) > 200
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_odd_rows(spark, network):
    rows = [(None, "the and of this that with", 1), (1, None, 1), (1, "", 1), (2, "123 !? 4", 1), (2, "123 !? 4", 1), (3, "the of and to " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted([(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, network).collect()], key=str)
    assert [g[1] for g in got] == ["und", "und", "und", "und", "en", "en"]
    assert [g[2] for g in got][:4] == [0.0] * 4
    kept = langid.drop_undetermined(docs, network)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "None"]
    assert langid.identify(docs.limit(0), network).collect() == []
    nothing = langid.train(spark.createDataFrame([(None, "x"), ("en", None), ("en", "12")], "lang string, text string"))
    assert nothing is None and {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_low_scores_stay(spark):
    network = langid.Network.new(["de", "en", "fr", "nl"])
    network.out[:] = 0  # no evidence: every language has the same share
    texts = ["A.", "Re.", "This.", "Von.", "the der und of", None, "", "12 !"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {r.doc_id: r.score for r in langid.identify(docs, network).collect()}
    assert all(0 < scores[k] < 0.5 for k in range(5))
    assert sorted(r.doc_id for r in langid.drop_undetermined(docs, network).collect()) == [0, 1, 2, 3, 4]
