"""Packing: all documents concatenated and cut into sequences, by two passes of prefix sums."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queuescope.llm.common import IS_WORD, KnownWords, Scratch, distinct_words, shards, text_buffer, word_spans, worker_state

LENGTH = 4096
END_ID = 2

SHARD_BYTES = 2_000_000
#: Units that are encoded in one call; the tokenizer's own records of a unit are large.
ENCODE_UNITS = 1024
#: Units whose ids a Python worker remembers, some 60 bytes each.
CACHE_UNITS = 1_500_000
#: Run totals that one task adds up.
BLOCK_RUNS = 1024
#: Runs whose offsets (16 bytes each) are sent to every executor; beyond it they are joined by a shuffle.
BROADCAST_RUNS = 200_000

#: How a tokenizer must normalise and split for its texts to be cut into units (fixed values).
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[:0x80] = _SIGN
_KIND[~IS_WORD] = _SPACE
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def cuts_of(data: np.ndarray) -> np.ndarray:
    """Places inside words where the tokenizer's pre-tokens end whatever stands around them.

    Letters, digits and ASCII signs next to each other are different pre-tokens, except that an
    apostrophe may draw in the letters behind it. Letters are those of ASCII and U+00C0 to U+024F but
    the two signs in that block and U+0130, which lower case turns into a letter and a mark. Around
    any other character nothing is cut, since it may be a sign, a blank or combine with its neighbour.
    """
    kind = _KIND[data]
    if len(data) > 1:
        lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))
        pair = data[lead].astype(np.int32) << 8 | data[lead + 1]
        lead = lead[~np.isin(pair, [0xC397, 0xC3B7, 0xC4B0])]
        kind[lead] = kind[lead + 1] = _LETTER
    left, right = kind[:-1], kind[1:]
    cut = (left != right) & (left != _SPACE) & (right != _SPACE) & (left != _OTHER) & (right != _OTHER)
    cut &= ~((data[:-1] == 0x27) & (right == _LETTER))
    return np.flatnonzero(cut) + 1


class Units:
    """Token ids of text units, encoded once each and remembered; a remembered unit is compared by its bytes."""

    def __init__(self, config: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        parts = json.loads(config)
        norm, split = parts["normalizer"] or {}, (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_unit = (
            norm.get("normalizers") == _NORMALIZERS
            and split[0].get("pattern") == {"Regex": _SPLIT}
            and split[0].get("behavior") == "Removed"
            and [x["type"] for x in split] == ["Split", "ByteLevel"]
            and not split[1]["add_prefix_space"]
            and not any(x["lstrip"] or x["rstrip"] or x["normalized"] for x in parts["added_tokens"])
        )
        self.added = [x["content"] for x in parts["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        self.known = KnownWords()
        #: Known unit k has the ids flat[begin[k]:begin[k + 1]].
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, and the number of ids of each."""
        flat, size = [np.zeros(0, np.uint32)], []
        for at in range(0, len(texts), ENCODE_UNITS):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts[at : at + ENCODE_UNITS], add_special_tokens=False)]
            size += map(len, ids)
            flat.append(np.array([i for x in ids for i in x], np.uint32))
        return np.concatenate(flat), np.array(size, np.int64)

    def _learn(self, units: list[bytes]) -> None:
        ids, number = self.encode([u.decode() for u in units])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(number)])
        self.flat = np.concatenate([self.flat, ids])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, and the number of ids before each text (one more at the end)."""
        if not self.by_unit:
            ids, size = self.encode([t or "" for t in texts.to_pylist()])
            return ids, np.concatenate(([0], np.cumsum(size)))
        data, starts = text_buffer(texts)
        raw, data = data, _LOWER[data]
        begin, end, before = word_spans(data, starts, IS_WORD, cuts_of(data))
        keys, first, unit = distinct_words(data, begin, end)
        if len(self.known) > CACHE_UNITS:
            self._forget()
        number, new = self.known.numbers(data, begin[first], end[first], keys)
        if new:
            self._learn(new)
        at = number[unit]
        size = self.begin[at + 1] - self.begin[at]
        ids = self.flat[_ranges(self.begin[at], size)]
        upto = np.concatenate([[0], np.cumsum(size)])[before]
        # The strings of added tokens are found in the text as it is, so such texts are encoded whole.
        everything = raw.tobytes()
        odd = sorted({k for token in self.added if token.encode() in everything
                      for k, t in enumerate(texts.to_pylist()) if t and token in t})
        if odd:
            parts = [ids[a:b] for a, b in zip(upto, upto[1:], strict=False)]
            for k in odd:
                parts[k] = self.encode([texts[k].as_py()])[0]
            ids, upto = np.concatenate(parts), np.cumsum([0] + [len(x) for x in parts])
        return ids, upto


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 ... for ``size[0]`` numbers, then the same for the next."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def id_type(config: str, end_id: int) -> str:
    """Storage of ids: 16 bits if all ids of the tokenizer fit."""
    parts = json.loads(config)
    vocab = parts["model"]["vocab"]
    largest = max([end_id, len(vocab), *(vocab.values() if isinstance(vocab, dict) else []), *(x["id"] for x in parts["added_tokens"])])
    return "<u2" if largest < 1 << 16 else "<u4"


def tokens(docs: DataFrame, config: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Per document its ids with the end id, and its place in the task's run.

    Ids are little-endian numbers of 16 bits where the vocabulary allows it, else of 32.
    """
    kind = id_type(config, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        state = worker_state()
        if state.get("config") != config:
            state["config"], state["units"] = config, Units(config)
        units, number, at = state["units"], TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch, texts in shards(whole, whole.column(1), SHARD_BYTES):
                ids, upto = units.ids(texts)
                end = np.array([end_id], kind).tobytes()
                raw, width = memoryview(ids.astype(kind).tobytes()), len(end)
                packed = [bytes(raw[width * a : width * b]) + end for a, b in zip(upto, upto[1:], strict=False)]
                size = np.diff(upto) + 1
                start = at + np.cumsum(size) - size
                at += int(size.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(size), number)), pa.array(start), batch.column(0), pa.array(size), pa.array(packed, pa.binary())],
                    names=["run", "at", "doc_id", "n", "ids"],
                )

    id_kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"run long, at long, doc_id {id_kind}, n long, ids binary")


def run_offsets(tokens_: DataFrame) -> DataFrame:
    """(run, base): the number of tokens in all runs before each.

    Totals of blocks of runs are summed first, then the runs in each block, so no task sees more
    than a block of runs or one row per block.
    """
    runs = tokens_.groupBy("run").agg(F.sum("n").alias("total"))
    runs = runs.withColumn("block", F.floor(F.col("run") / BLOCK_RUNS))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.sum("total").over(earlier.partitionBy("block").orderBy("run"))
    blocks = runs.groupBy("block").agg(F.sum("total").alias("sum"))
    blocks = blocks.select("block", F.coalesce(F.sum("sum").over(earlier.orderBy("block")), F.lit(0)).alias("before"))
    inner = runs.select("run", "block", F.coalesce(inside, F.lit(0)).alias("inside"))
    return inner.join(blocks, "block").select("run", (F.col("before") + F.col("inside")).alias("base"))


def pieces(placed: DataFrame, length: int, stored_type: str) -> DataFrame:
    """Cut each document where a sequence ends. ``placed`` has (doc_id, n, first, ids)."""
    width = int(stored_type[-1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            sequence = first // length
            count = (first + n - 1) // length - sequence + 1
            doc = np.repeat(np.arange(len(n)), count)
            sequence = _ranges(sequence, count)
            begin = np.maximum(sequence * length, first[doc])
            size = np.minimum((sequence + 1) * length, (first + n)[doc]) - begin
            start = begin - first[doc]
            ids = batch.column(3)
            raw = [memoryview(x.as_buffer()) for x in ids]
            parts = [
                np.frombuffer(raw[d][width * a : width * (a + s)], stored_type).astype("<u4").tobytes()
                for d, a, s in zip(doc, start, size, strict=True)
            ]
            columns = [start, size, sequence, begin - sequence * length, n[doc]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), *map(pa.array, columns), pa.array(parts, pa.binary())],
                names=["doc_id", "start", "length", "sequence_id", "offset", "doc_tokens", "ids"],
            )

    kind = dict(placed.dtypes)["doc_id"]
    return placed.select("doc_id", "n", "first", "ids").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, sequence_id long, offset long, doc_tokens long, ids binary"
    )


def pack(
    docs: DataFrame,
    config: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``sequence_id``, ``offset``, ``doc_tokens``, ``ids``.

    ``config`` is a tokenizer file's text. The ids of all documents, each followed by ``end_id``, form
    one row of tokens, and every ``length`` of them are a sequence; only the last one may be shorter,
    so nothing but its rest is padding. A document that spans a boundary gives one piece on each side.
    ``ids`` are the piece's ids as little-endian 32-bit numbers.

    A NULL or empty text has the end id alone. Repeated rows and rows without an id are packed like any
    other. A text of any length is cut as often as needed. An empty table gives an empty result.
    Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    stored = scratch.store(tokens(docs, config, end_id, id_col, text_col), "tokens")
    offsets = run_offsets(stored)
    few = offsets.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
    placed = stored.join(F.broadcast(offsets) if few else offsets, "run")
    return pieces(placed.withColumn("first", F.col("base") + F.col("at")), length, id_type(config, end_id))
