"""Substring dedup by fixed-block anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.llm.common import (
    IS_WORD,
    Scratch,
    bits_for,
    chunks,
    covered,
    hash_words,
    open_chunk,
    runs,
    text_buffer,
    window_hashes,
    word_spans,
)

WINDOW = 20

#: Text bytes of one chunk, the unit in which texts are looked at. Larger chunks make fewer and
#: fuller messages; on 100 TB take the text of a whole input partition.
CHUNK_BYTES = 8_000_000
#: Hashes that one bucket gets, on average.
BUCKET_HASHES = 4_000_000
#: Bits of a block's hash beyond the binary logarithm of their number. A chance match costs a
#: look at its surroundings and changes nothing.
SPARE_BITS = 8


# --- Sorted numbers as small differences -------------------------------------------------------


def _pack_sorted(values: np.ndarray) -> bytes:
    """Differences of sorted numbers in 16 or 32 bits; the largest code says "add it and go on"."""
    steps = np.diff(values, prepend=np.uint64(0))
    kind = np.uint16 if len(values) and int(values[-1]) // len(values) < 1 << 15 else np.uint32
    full = np.uint64(np.iinfo(kind).max)
    over = (steps // full).astype(np.int64)
    out = np.full(int(over.sum()) + len(steps), full, kind)
    out[np.cumsum(over + 1) - 1] = steps % full
    return bytes([out.itemsize]) + out.tobytes()


def _unpack_sorted(data: bytes) -> np.ndarray:
    kind = np.uint16 if data[0] == 2 else np.uint32
    codes = np.frombuffer(data, kind, offset=1)
    return np.cumsum(codes.astype(np.uint64))[codes != np.iinfo(kind).max]


# --- A chunk: texts, and their words as hashes -------------------------------------------------


class Chunk:
    """Word hashes of a chunk's texts; words are numbered through the chunk."""

    def __init__(self, data: bytes, window: int):
        self.ids, self.texts = open_chunk(data)
        self.counts, self.words = self.hashed(1)
        self.window = window
        self.block = (window + 1) // 2  # a window of 2n - 1 words has a whole block of n
        doc = np.repeat(np.arange(len(self.texts)), np.diff(self.counts))
        self.place = np.arange(len(self.words)) - self.counts[doc]
        self.left = self.counts[doc + 1] - np.arange(len(self.words))

    def hashed(self, seed: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The number of words before each text, and a hash of each word; 0 for words not asked for."""
        raw, starts = text_buffer(self.texts)
        begin, end, counts = word_spans(raw, starts, IS_WORD)
        if asked is None:
            return counts, hash_words(raw, begin, end, seed)
        out = np.zeros(len(begin), np.uint64)
        out[asked] = hash_words(raw, begin[asked], end[asked], seed)
        return counts, out

    def blocks(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, hash, whether a reference block) of every rolling block in texts that have a window."""
        at = np.flatnonzero((self.left >= self.block) & (self.place + self.left >= self.window))
        hashes = window_hashes(self.words, self.block)[at] >> np.uint64(64 - bits)
        return at, hashes, self.place[at] % self.block == 0

    def candidates(self, hits: np.ndarray, bits: int) -> np.ndarray:
        """First words of the windows around blocks that have a hit: the hit is extended both ways."""
        if not len(hits):
            return np.zeros(0, np.int64)
        at, hashes, _ = self.blocks(bits)
        found = np.minimum(np.searchsorted(hits, hashes), len(hits) - 1)
        at = at[hits[found] == hashes]
        near = covered(np.maximum(at - (self.window - self.block), 0), at + 1, len(self.words))
        return np.flatnonzero(near & (self.left >= self.window))

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct windows of the chunk, each with its earliest place, and the entry of each window."""
        entry = np.zeros(len(at), ENTRY)
        entry["hash"] = window_hashes(self.words, self.window)[at]
        _, again = self.hashed(2, covered(at, at + self.window, len(self.words)))
        entry["check"] = window_hashes(again, self.window, seed=2)[at] >> np.uint64(32)
        doc = np.searchsorted(self.counts, at, "right") - 1
        entry["no_id"] = self.ids.is_null().to_numpy(zero_copy_only=False)[doc]
        entry["id"] = np.nan_to_num(self.ids.fill_null(0).to_numpy())[doc]
        entry["word"] = at
        order = np.lexsort([entry[k] for k in ("word", "id", "no_id", "check", "hash")])
        entry = entry[order]
        new = np.ones(len(at), bool)
        new[1:] = (entry["hash"][1:] != entry["hash"][:-1]) | (entry["check"][1:] != entry["check"][:-1])
        of = np.empty(len(at), np.int64)
        of[order] = np.cumsum(new) - 1
        return entry[new], of


#: A window: 64 and 32 bits of two hashes with word hashes of their own, and the place that decides which of equal windows is first.
ENTRY = np.dtype([("hash", "<u8"), ("check", "<u4"), ("no_id", "u1"), ("id", "<i8"), ("word", "<u4")])


def _index(stored: DataFrame, window: int, bits: int, bucket_bits: int) -> DataFrame:
    """(bucket, chunk, data): each distinct block hash of a chunk once, by the hash's first bits."""
    low = np.uint64((1 << (bits - bucket_bits)) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, hashes, reference = Chunk(data.as_py(), window).blocks(bits)
                both = np.sort(hashes << np.uint64(1) | reference.astype(np.uint64))
                hashes = both >> np.uint64(1)
                first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(both) else [])
                last = np.append(first[1:], len(both)) - 1 if len(first) else first
                hashes, reference, more = hashes[first], both[last] & np.uint64(1), last > first
                bucket = (hashes >> np.uint64(bits - bucket_bits)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange((1 << bucket_bits) + 1))
                full = np.flatnonzero(cuts[1:] > cuts[:-1])
                parts = [slice(cuts[k], cuts[k + 1]) for k in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full), pa.array(np.full(len(full), number)),
                     pa.array([_pack_sorted(hashes[p] & low) for p in parts], pa.binary()),
                     pa.array([np.packbits(reference[p].astype(bool)).tobytes() for p in parts], pa.binary()),
                     pa.array([np.packbits(more[p]).tobytes() for p in parts], pa.binary())],
                    names=["bucket", "chunk", "hashes", "reference", "more"],
                )

    return stored.select("chunk", "data").mapInArrow(
        send, "bucket long, chunk long, hashes binary, reference binary, more binary"
    )


def _hits(index: DataFrame, bits: int, bucket_bits: int) -> DataFrame:
    """(chunk, data): the hashes of a chunk that a reference block has, here or in another place."""

    def probe(group: pd.DataFrame) -> pd.DataFrame:
        lists = [_unpack_sorted(x) for x in group["hashes"]]
        size = np.array([len(x) for x in lists])
        flags = [
            np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(group[c], size, strict=True)])
            for c in ("reference", "more")
        ]
        hashes, of = np.concatenate(lists), np.repeat(np.arange(len(lists)), size)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        count = np.diff(np.append(first, len(hashes)))
        reference, more = (np.maximum.reduceat(f[order], first) > 0 for f in flags)
        hit = np.repeat(reference & (more | (count > 1)), count)
        hashes, of = hashes[hit], of[order][hit]
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
        cuts = np.searchsorted(of, np.arange(len(lists) + 1))
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        top = np.uint64(int(group["bucket"].iloc[0]) << (bits - bucket_bits))
        return pd.DataFrame(
            {"chunk": group["chunk"].to_numpy()[full],
             "data": [_pack_sorted(hashes[cuts[k] : cuts[k + 1]] | top) for k in full]}
        )

    return index.groupBy("bucket").applyInPandas(probe, "chunk long, data binary")


def _hit_list(group: pd.DataFrame) -> np.ndarray:
    lists = [_unpack_sorted(x) for x in group.loc[group["kind"] == "hits", "data"]]
    return np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)


def _windows(parts: DataFrame, window: int, bits: int, bucket_bits: int) -> DataFrame:
    """(bucket, chunk, data): the distinct candidate windows of a chunk with their earliest place."""

    def extend(group: pd.DataFrame) -> pd.DataFrame:
        hits = _hit_list(group)
        out = {"bucket": [], "chunk": [], "data": []}
        if len(hits):
            chunk = Chunk(group.loc[group["kind"] == "text", "data"].iloc[0], window)
            entry, _ = chunk.entries(chunk.candidates(hits, bits))
            bucket = (entry["hash"] >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(entry), np.int64)
            cuts = np.searchsorted(bucket, np.arange((1 << bucket_bits) + 1))
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            out = {"bucket": full, "chunk": group["chunk"].iloc[0], "data": [entry[cuts[k] : cuts[k + 1]].tobytes() for k in full]}
        return pd.DataFrame(out)

    return parts.groupBy("chunk").applyInPandas(extend, "bucket long, chunk long, data binary")


def _first(windows: DataFrame) -> DataFrame:
    """(chunk, bucket, data): one bit for each window that a chunk sent, set if none is earlier."""

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")  # of rows with one id, those of earlier chunks come first
        lists = [np.frombuffer(x, ENTRY) for x in group["data"]]
        entry = np.concatenate(lists)
        size = np.array([len(x) for x in lists])
        order = np.lexsort([entry[k] for k in ("id", "no_id", "check", "hash")])
        sent = entry[order]
        new = np.ones(len(sent), bool)
        new[1:] = (sent["hash"][1:] != sent["hash"][:-1]) | (sent["check"][1:] != sent["check"][:-1])
        first = np.empty(len(sent), bool)
        first[order] = new
        cuts = np.concatenate(([0], np.cumsum(size)))
        return pd.DataFrame(
            {"chunk": group["chunk"].to_numpy(), "bucket": group["bucket"].to_numpy(),
             "data": [np.packbits(first[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]}
        )

    return windows.groupBy("bucket").applyInPandas(decide, "chunk long, bucket long, data binary")


def _removed(parts: DataFrame, window: int, bits: int, bucket_bits: int) -> DataFrame:
    def remove(group: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(group.loc[group["kind"] == "text", "data"].iloc[0], window)
        gone = np.zeros(len(chunk.words), bool)
        at = chunk.candidates(_hit_list(group), bits)
        if len(at):
            entry, of = chunk.entries(at)
            bucket = (entry["hash"] >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(entry), np.int64)
            number = np.bincount(bucket, minlength=1 << bucket_bits)
            told = group[group["kind"] == "first"].sort_values("bucket")
            first = np.concatenate(
                [np.unpackbits(np.frombuffer(x, np.uint8), count=number[int(b)]) for x, b in zip(told["data"], told["bucket"], strict=True)]
            )
            stays = (first[of] > 0) & (entry["word"][of] == at)
            gone = covered(at[~stays], at[~stays] + window, len(gone))
        spans, kept = [], []
        total = np.concatenate(([0], np.cumsum(gone)))
        for k, text in enumerate(chunk.texts.to_pylist()):
            a, b = chunk.counts[k], chunk.counts[k + 1]
            words = (text or "").encode().split()
            if total[b] > total[a]:
                own = gone[a:b]
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(*runs(own), strict=True)])
                words = [w for w, g in zip(words, own, strict=True) if not g]
            else:
                spans.append([])
            kept.append(b" ".join(words).decode())
        out = pd.DataFrame({"n_words": np.diff(chunk.counts), "removed": spans, "kept": kept})
        out.insert(0, "doc_id", pd.array(chunk.ids.to_pylist(), "Int64"))
        return out

    return parts.groupBy("chunk").applyInPandas(
        remove, "doc_id long, n_words long, removed array<struct<start: long, end: long>>, kept string"
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``removed`` (word spans), ``kept`` (text).

    Words are split at ASCII white space. A word is removed if it lies in a window of ``window``
    consecutive words whose sequence also starts earlier: in a document with a smaller id, or earlier
    in the same one. Windows are judged on the input. ``kept`` joins the other words by one space.

    The index has the hash of every block of half a window that starts at a multiple of its length;
    every rolling block of that length is a probe. A repeated window has such a block in its first
    place, so around one of its blocks there is a hit. Hits are extended to the windows around them,
    equal windows are found by 96 bits of hash, and removed windows that touch form maximal spans.
    A chunk sends each hash once, so frequent passages weigh no more than others.

    Ids are whole numbers. A NULL or empty text has no words. Rows without an id come after all others; among rows with the
    same id, which repeated rows are too, one is earlier by its place in the table. Texts shorter than
    a window stay as they are. An empty table gives an empty result. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "substring")
    stored = scratch.store(chunks(docs, CHUNK_BYTES), "chunks")
    total = stored.agg(F.sum("words")).first()[0] or 0
    bucket_bits = bits_for(total, BUCKET_HASHES)
    bits = min(62, max(32, total.bit_length() + SPARE_BITS))
    hits = scratch.store(_hits(_index(stored, window, bits, bucket_bits), bits, bucket_bits), "hits")
    none = F.lit(None).cast("long").alias("bucket")
    text = stored.select("chunk", F.lit("text").alias("kind"), none, "data")
    parts = text.union(hits.select("chunk", F.lit("hits").alias("kind"), none, "data"))
    first = scratch.store(_first(_windows(parts, window, bits, bucket_bits)), "first")
    told = first.select("chunk", F.lit("first").alias("kind"), "bucket", "data")
    return _removed(parts.union(told), window, bits, bucket_bits)
