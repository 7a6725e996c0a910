import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models

import public_tokenizers
from queuescope.llm import tokencount
from tests.llm.words import thue_morse


@pytest.fixture(scope="module")
def pieces():
    return tokencount.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))


def plain(unit, pieces, byte):
    best = [(0.0, 0)]
    for n in range(1, len(unit) + 1):
        ways = [(-best[k][0] - pieces[unit[k:n]], best[k][1] + 1) for k in range(n) if unit[k:n] in pieces]
        if unit[n - 1] not in pieces:
            size = len(unit[n - 1].encode())
            ways.append((-best[n - 1][0] - size * byte, best[n - 1][1] + size))
        score, number = min(ways)
        best.append((-score, number))
    return best[-1]


def units_of(seed=4):
    rng = random.Random(seed)
    syllables = ["th", "in", "en", "heit", "ción", "éau", "ß", "日", "1", "9", "!", "😀", "a", "q"]
    return sorted({"▁" * rng.randint(0, 1) + "".join(rng.choice(syllables) for _ in range(rng.randint(1, 9))) for _ in range(1500)})


def test_shared_prefixes_change_nothing(pieces):
    counter, units = tokencount.Counter(pieces), units_of()
    assert counter.count_sorted(units) == [plain(u, pieces, counter.byte)[1] for u in units]


def test_agrees_with_a_unigram_tokenizer(pieces):
    known = [u for u in units_of(7) if all(c in pieces for c in u)]
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], unk_id=0))
    counter = tokencount.Counter(pieces)
    got = counter.count_sorted(known)
    want = [len(x.ids) for x in model.encode_batch(known)]
    assert sum(g != w for g, w in zip(got, want, strict=True)) == 0


def test_texts_add_up(pieces):
    counter = tokencount.Counter(pieces)
    texts = ["the  cat's 42 hats!", None, "", "the cat", " \n", "the " * 30_000]
    for _ in range(2):
        tokens, units = counter.of(pa.array(texts))
        def count(*x):
            return sum(plain(u, pieces, counter.byte)[1] for u in x)

        assert tokens[0] == count("▁the", "▁cat", "'s", "▁42", "▁hats", "!")
        assert tokens[3] == count("▁the", "▁cat") and tokens[5] == 30_000 * count("▁the")
        assert tokens[[1, 2, 4]].tolist() == [0] * 3 and units.tolist() == [6, 0, 0, 2, 0, 30_000]


def test_odd_rows(spark, pieces):
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 1), (1, "", 1), (2, "a b", 1), (2, "a b", 1)], "doc_id int, text string, n_tokens int")
    got = tokencount.count_tokens(docs, pieces).collect()
    assert sorted((str(r.doc_id), r.n_pretokens) for r in got) == [("1", 0), ("1", 0), ("2", 2), ("2", 2), ("None", 2)]
    assert tokencount.count_tokens(docs.limit(0), pieces).collect() == []
    assert {r.n_tokens for r in tokencount.count_tokens(docs, {}).collect()} == {0, 2 * len("▁a".encode())}


def test_words_of_one_polynomial_hash():
    pieces = {"a": -1.0, "b": -1.0, "ab": -1.5, "abb": -1.2}
    for size in (512, 2048):
        word, other = thue_morse(size)
        counter = tokencount.Counter(pieces)
        want = [plain("▁" + w, pieces, counter.byte)[1] for w in (word, other)]
        assert counter.of(pa.array([word, other]))[0].tolist() == want
        assert want[0] != want[1]
