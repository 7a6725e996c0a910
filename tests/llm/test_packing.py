import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from queuescope.llm import common, packing
from tests.llm.words import thue_morse

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(9)
    bits = list("aZéßİÅ ×÷'’\"!.,-_0159̸́ \u0085\x1c\t\n…–日本ΣςǅŉſK😀‍<|>")
    bits += ["'s", "'ll", "it's", "don't", "<|endoftext|>", "<|startoftext|>", "the", " ", " ", "...", "Å", "≠"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    return out + ["", None, "word " * 20000, "x" * 5000]


def test_units_give_the_tokenizer_s_ids(tokenizer):
    import pyarrow as pa

    texts = odd_texts()
    units = packing.Units(open(PATH).read())
    assert units.by_unit
    for _ in range(2):
        ids, upto = units.ids(pa.array(texts))
        got = [ids[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)]
        want = [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [(t, g) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


@pytest.mark.parametrize("size", [512, 2048])
def test_words_of_one_polynomial_hash(tokenizer, size):
    import pyarrow as pa

    texts = [f"a {w} b" for w in thue_morse(size)] * 2
    ids, upto = packing.Units(open(PATH).read()).ids(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)]
    assert got == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got[0] != got[1]


def test_units_that_share_a_key(tokenizer, monkeypatch):
    """With two keys for all units, every unit still gets its own ids."""
    import pyarrow as pa

    plain = common.hash_words
    monkeypatch.setattr(common, "hash_words", lambda *a, **k: plain(*a, **k) & np.uint64(1))
    monkeypatch.setattr(common, "SURE_WORD", 0)
    texts = odd_texts()[:300]
    units = packing.Units(open(PATH).read())
    for part in (texts[:100], texts[50:200], texts):
        ids, upto = units.ids(pa.array(part))
        got = [ids[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)]
        assert got == [x.ids for x in tokenizer.encode_batch(part, add_special_tokens=False)]


def test_other_tokenizers_are_used_on_whole_texts():
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    units = packing.Units(open(path).read())
    assert not units.by_unit
    ids, upto = units.ids(pa.array(["a  b", None]))
    assert ids.tolist() == Tokenizer.from_file(path).encode("a  b").ids and upto.tolist()[1:] == [len(ids)] * 2


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_round_trip(spark, tokenizer, monkeypatch, broadcast):
    monkeypatch.setattr(packing, "BLOCK_RUNS", 2)
    monkeypatch.setattr(packing, "BROADCAST_RUNS", broadcast)
    texts = odd_texts()[-1500:]
    rows = [(k if k % 9 else None, t, 1, "a") for k, t in enumerate(texts)] + [(1, texts[1], 1, "a")] * 2
    docs = spark.createDataFrame(rows, "doc_id int, text string, run long, ids string").repartition(7)
    got = packing.pack(docs, open(PATH).read(), 64).collect()
    import numpy as np

    sequences, by_doc = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    assert sorted(sequences) == list(range(len(sequences)))
    for k, parts in sequences.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == 64 or k == len(sequences) - 1 and at <= 64
    for k, t in enumerate(texts):
        if k % 9 and k != 1:
            want = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
            assert [i for _, ids, _ in sorted(by_doc[k]) for i in ids] == want
            assert {n for _, _, n in by_doc[k]} == {len(want)}
    total = sum(len(x.ids) + 1 for x in tokenizer.encode_batch([t or "" for _, t, _, _ in rows], add_special_tokens=False))
    assert sum(r.length for r in got) == total
    assert packing.pack(docs.limit(0), open(PATH).read()).collect() == []
