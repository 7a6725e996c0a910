import numpy as np
import pyarrow as pa

from queuescope.llm import common
from tests.llm.words import thue_morse


def split(texts):
    data, starts = common.text_buffer(pa.array(texts))
    return (data, *common.word_spans(data, starts, common.IS_WORD)[:2])


def test_equal_words_and_no_others_share_a_hash():
    words = ["a", "b", "ab", "ba", "12345678", "123456789", "x" * 64, "x" * 65, "é" * 40, *thue_morse(64), *thue_morse(512), *thue_morse(2048)]
    words += ["y" * n for n in range(1, 140)]
    data, begin, end = split([" ".join(words), "\n".join(reversed(words))])
    for seed in (1, 2):
        hashes = common.hash_words(data, begin, end, seed)
        assert hashes.tolist() == hashes[::-1].tolist()
        assert len(set(hashes.tolist())) == len(words)
    assert not set(common.hash_words(data, begin, end, 1).tolist()) & set(common.hash_words(data, begin, end, 2).tolist())


def test_words_are_told_apart_by_bytes(monkeypatch):
    plain = common.hash_words
    monkeypatch.setattr(common, "hash_words", lambda *a, **k: plain(*a, **k) & np.uint64(1))
    monkeypatch.setattr(common, "SURE_WORD", 0)
    words = ["longword", "long" * 30, "long" * 29 + "lung", "longwort", "longer words", "longer wörts", "long" * 30, "eight by 8"] * 3
    data, begin, end = split([" ".join(words)])
    _, first, of = common.distinct_words(data, begin, end)
    got = [data[begin[first[k]] : end[first[k]]].tobytes().decode() for k in of]
    assert got == " ".join(words).split()
    assert len(first) == len(set(got))
