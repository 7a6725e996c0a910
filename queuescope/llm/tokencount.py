"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.llm.common import IS_WORD, KnownWords, distinct_words, shards, text_buffer, word_spans, worker_state
from queuescope.llm.packing import cuts_of

SHARD_BYTES = 16_000_000
#: Pre-tokens whose counts a Python worker remembers.
CACHE_UNITS = 2_000_000
#: Stands for the white space before a word.
BLANK = "▁"


def pieces_of(path: str) -> dict[str, float]:
    """The pieces of a public sentence-piece file with unigram log probabilities.

    The file ranks its pieces by the order in which they were merged; a piece's probability is taken
    to fall with the rank as word frequencies do (Zipf), so it is the logarithm of 1 / (rank + 2).
    Control and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [k for k in range(len(model)) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))]
    plain.sort(key=lambda k: (-model.get_score(k), k))
    return {model.id_to_piece(k): -math.log(rank + 2) for rank, k in enumerate(plain)}


class Counter:
    """Numbers of tokens in the best segmentation of pre-tokens."""

    def __init__(self, pieces: dict[str, float]):
        #: Trie of the reversed pieces; a piece's score stands under the empty string.
        self.reversed: dict = {}
        for piece, score in pieces.items():
            node = self.reversed
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.byte = min(pieces.values(), default=0.0) - 10.0
        self._forget()

    def _forget(self) -> None:
        #: Units without and with a blank before them, and the tokens of each.
        self.known = [KnownWords(), KnownWords()]
        self.counts = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def count_sorted(self, units: list[str]) -> list[int]:
        """Token counts of distinct, sorted pre-tokens.

        In sorted order the pre-tokens are the leaves of their trie from left to right. ``best`` and
        ``number`` hold the forward scores and counts along the current path from the root; the part
        that a pre-token shares with the one before it stays, so each node is computed once.

        Of equal scores the segmentation with fewer tokens counts. A character that is no piece is
        written as one token for each of its bytes.
        """
        best, number, path, out = [0.0], [0], "", []
        top = self.reversed
        for unit in units:
            shared, most = 0, min(len(path), len(unit))
            while shared < most and path[shared] == unit[shared]:
                shared += 1
            del best[shared + 1 :], number[shared + 1 :]
            for n in range(shared, len(unit)):
                node, k = top, n
                score, tokens = -math.inf, 0
                while k >= 0:
                    node = node.get(unit[k])
                    if node is None:
                        break
                    own = node.get("")
                    if own is not None:
                        new = best[k] + own
                        if new > score or new == score and number[k] + 1 < tokens:
                            score, tokens = new, number[k] + 1
                    k -= 1
                if "" not in top.get(unit[n], ()):
                    size = len(unit[n].encode())
                    new = best[n] + size * self.byte
                    if new > score:
                        score, tokens = new, number[n] + size
                best.append(score)
                number.append(tokens)
            path = unit
            out.append(number[-1])
        return out

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and pre-tokens of each text."""
        data, starts = text_buffer(texts)
        begin, end, before = word_spans(data, starts, IS_WORD, cuts_of(data))
        head = np.ones(len(begin), bool)
        head[1:] = begin[1:] != end[:-1]
        head[before[:-1][before[:-1] < len(head)]] = True
        keys, first, unit = distinct_words(data, begin, end)
        if sum(map(len, self.known)) > CACHE_UNITS:
            self._forget()
        each = np.empty(len(unit), np.int64)
        for blank in (0, 1):
            own = np.flatnonzero(head == blank)
            present = np.zeros(len(first), bool)
            present[unit[own]] = True
            some = np.flatnonzero(present)
            number, new = self.known[blank].numbers(data, begin[first[some]], end[first[some]], keys[some])
            if new:
                written = [BLANK * blank + u.decode() for u in new]
                order = sorted(range(len(new)), key=written.__getitem__)
                counts = np.empty(len(new), np.int64)
                counts[order] = self.count_sorted([written[k] for k in order])
                self.counts[blank] = np.concatenate([self.counts[blank], counts])
            of = np.zeros(len(first), np.int64)
            of[some] = self.counts[blank][number]
            each[own] = of[unit[own]]
        return np.diff(np.concatenate(([0], np.cumsum(each)))[before]), np.diff(before)


def count_tokens(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``n_pretokens``.

    Pre-tokens are runs of letters, of digits or of ASCII signs between ASCII white space (see
    ``packing.cuts_of``); the first of a word begins with a blank mark. Distinct pre-tokens of a shard
    go into a trie, and the best segmentation by the sum of log probabilities is found along it.

    A NULL or empty text has no tokens. With an empty vocabulary every byte is a token. Repeated rows
    and rows without an id give a row each; an empty table gives an empty result. Other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state()
        if state.get("pieces") != pieces:
            state["pieces"], state["counter"] = pieces, Counter(pieces)
        counter = state["counter"]
        for whole in batches:
            for batch, texts in shards(whole, whole.column(1), SHARD_BYTES):
                tokens, units = counter.of(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(tokens), pa.array(units)], names=["doc_id", "n_tokens", "n_pretokens"]
                )

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pretokens long")
