"""Language-model scores with stupid backoff, from n-gram counts partitioned by hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.llm.common import IS_WORD, Scratch, bits_for, chunks, grouped, hash_words, mix, open_chunk, text_buffer, window_hashes, word_spans

#: Words of the longest n-gram.
ORDER = 2
#: Weight of the shorter n-gram where the longer one is unseen.
BACKOFF = 0.4
#: Count of a word that no other document has.
UNSEEN = 0.5

CHUNK_BYTES = 8_000_000
#: N-grams that one bucket gets, on average; each chunk sends a distinct one once.
BUCKET_NGRAMS = 2_000_000

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _pack_hashes(values: np.ndarray) -> bytes:
    """Sorted hashes byte by byte: the first bytes repeat and shrink."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack_hashes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()


def _pack_counts(values: np.ndarray) -> bytes:
    kind = np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint64
    out = values.astype(kind)
    head = len(out).to_bytes(7, "little") + bytes([out.itemsize])
    return head + pa.compress(out.tobytes(), codec="zstd", asbytes=True)


def _unpack_counts(data: bytes) -> np.ndarray:
    n, size = int.from_bytes(data[:7], "little"), data[7]
    raw = pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, {2: np.uint16, 8: np.uint64}[size]).astype(np.int64)


class Grams:
    """The n-grams of a chunk up to ``order`` words, as hashes, and how often it has each."""

    def __init__(self, data: bytes, order: int):
        self.ids, texts = open_chunk(data)
        raw, starts = text_buffer(texts)
        raw = _LOWER[raw]
        begin, end, self.counts = word_spans(raw, starts, IS_WORD)
        words = hash_words(raw, begin, end)
        del raw, begin, end
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.counts))
        self.n_words = len(words)
        #: The last word of each n-gram, for n = 1, 2 ...
        self.ends = [np.arange(len(words))]
        hashes = [words]
        for n in range(2, order + 1):
            at = np.flatnonzero(doc[n - 1 :] == doc[: 1 - n]) + n - 1
            hashes.append(window_hashes(words, n)[at - n + 1])
            self.ends.append(at)
        self.doc = np.concatenate([doc[at] for at in self.ends])
        self.hashes = np.concatenate(hashes)
        del words, hashes, doc
        self.distinct, self.gram, self.number = grouped(self.hashes)

    def parts(self, bucket_bits: int) -> list[tuple[int, slice]]:
        """(bucket, entries) by the first bits of the hash."""
        if not bucket_bits:
            return [(0, slice(0, len(self.distinct)))] if len(self.distinct) else []
        bucket = (self.distinct >> np.uint64(64 - bucket_bits)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange((1 << bucket_bits) + 1))
        return [(k, slice(cuts[k], cuts[k + 1])) for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()]

    def others(self, total: np.ndarray) -> list[np.ndarray]:
        """For each n and each n-gram, how often all other documents have it."""
        _, own, number = grouped(mix(self.hashes + mix(self.doc.astype(np.uint64) + np.uint64(1))))
        return np.split(total[self.gram] - number[own], np.cumsum([len(at) for at in self.ends])[:-1])


def _counted(stored: DataFrame, bucket_bits: int, order: int) -> DataFrame:
    """(bucket, chunk, hashes, counts): the chunk's distinct n-grams."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = Grams(data.as_py(), order)
                parts = grams.parts(bucket_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in parts], pa.int64()), pa.array([number] * len(parts), pa.int64()),
                     pa.array([_pack_hashes(grams.distinct[p]) for _, p in parts], pa.binary()),
                     pa.array([_pack_counts(grams.number[p]) for _, p in parts], pa.binary())],
                    names=["bucket", "chunk", "hashes", "counts"],
                )

    return stored.select("chunk", "data").mapInArrow(send, "bucket long, chunk long, hashes binary, counts binary")


def _totals(counted: DataFrame) -> DataFrame:
    """(chunk, bucket, data): the corpus counts of the n-grams that a chunk sent, in their order."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        lists = [_unpack_hashes(x) for x in group["hashes"]]
        hashes = np.concatenate(lists)
        counts = np.concatenate([_unpack_counts(x) for x in group["counts"]])
        cuts = np.cumsum([0] + [len(x) for x in lists])
        del lists
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        total = np.add.reduceat(counts[order], first)
        back = np.empty(len(hashes), np.int64)
        back[order] = np.repeat(total, np.diff(np.append(first, len(hashes))))
        return pd.DataFrame(
            {"chunk": group["chunk"].to_numpy(), "bucket": group["bucket"].to_numpy(),
             "data": [_pack_counts(back[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]}
        )

    return counted.groupBy("bucket").applyInPandas(add, "chunk long, bucket long, data binary")


def _scored(parts: DataFrame, all_words: int, order: int) -> DataFrame:
    def score(group: pd.DataFrame) -> pd.DataFrame:
        grams = Grams(group.loc[group["kind"] == "text", "data"].iloc[0], order)
        told = group[group["kind"] == "counts"].sort_values("bucket")
        total = np.concatenate([np.zeros(0, np.int64), *map(_unpack_counts, told["data"])])
        others = grams.others(total)
        word, words = others[0], grams.doc[: grams.n_words]
        size = np.diff(grams.counts)
        value = np.log(np.maximum(word, UNSEEN) / np.maximum(all_words - size, 1)[words])
        backoff, unseen = np.zeros(grams.n_words, np.int64), (word == 0).astype(np.int64)
        place = np.empty(grams.n_words, np.int64)
        for n in range(1, order):
            at, seen, shorter = grams.ends[n], others[n] > 0, others[n - 1]
            place[grams.ends[n - 1]] = np.arange(len(shorter))  # of the shorter n-gram that ends at a word
            value[at[~seen]] += np.log(BACKOFF)
            value[at[seen]] = np.log(others[n][seen] / shorter[place[at[seen] - 1]])
            backoff[at] = ~seen
        sums = np.concatenate(([0.0], np.cumsum(value)))
        per = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[grams.counts])
        # A running sum loses digits over a chunk; each document is added up for itself.
        full = np.flatnonzero(size)
        sums = np.zeros(len(size))
        sums[full] = np.add.reduceat(value, grams.counts[:-1][full]) if len(full) else 0.0
        out = pd.DataFrame({"n_words": size, "n_backoff": per(backoff), "n_unseen": per(unseen), "log_score": sums})
        out.insert(0, "doc_id", pd.array(grams.ids.to_pylist(), "Int64"))
        return out

    return parts.groupBy("chunk").applyInPandas(
        score, "doc_id long, n_words long, n_backoff long, n_unseen long, log_score double"
    )


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_backoff``, ``n_unseen``, ``log_score``.

    A-Z are lower-cased and words split at ASCII white space. Each word is scored given up to ``order - 1``
    words before it, by the counts of all other documents: the share of the n-gram among the occurrences
    of the words before; if no other document has the n-gram, ``BACKOFF`` times the score given one word
    less. A word alone has its share of all words, in which an unseen word counts ``UNSEEN``. ``log_score``
    is the sum of natural logarithms. ``n_backoff`` counts the words whose longest n-gram is unseen; the
    first words of a document have shorter ones, and the very first none.

    The corpus counts are a table of n-gram hashes in buckets by the hash's first bits. Texts are taken
    chunk by chunk; a chunk sends each distinct n-gram once with its count, the bucket adds up and
    answers with the corpus count, and the answers meet the chunk's n-grams again.

    Ids are whole numbers. A NULL or empty text has no words and score 0. A repeated row is another document, so it has the
    n-grams of its copy. Rows without an id are documents like any other. An empty table gives an empty
    result. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "lm")
    stored = scratch.store(chunks(docs, CHUNK_BYTES), "chunks")
    words = stored.agg(F.sum("words")).first()[0] or 0
    bucket_bits = bits_for(order * words, BUCKET_NGRAMS)
    totals = scratch.store(_totals(_counted(stored, bucket_bits, order)), "totals")
    none = F.lit(None).cast("long").alias("bucket")
    text = stored.select("chunk", F.lit("text").alias("kind"), none, "data")
    return _scored(text.union(totals.select("chunk", F.lit("counts").alias("kind"), "bucket", "data")), words, order)
