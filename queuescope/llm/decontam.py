"""Benchmark decontamination: an FM-index per shard of the training text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuescope.llm.common import Scratch, byte_table, covered, distinct_words, hash_words, runs, same_words, shards, text_buffer, word_spans

WINDOW = 13

#: Benchmark characters that are searched in one pass over the documents.
BLOCK_CHARS = 8_000_000
#: Passes whose phrases are in memory at the same time; then the documents are stored.
CHAIN = 4
#: Bytes of text behind one FM-index, at least one document.
SHARD_BYTES = 16_000_000
#: Text positions between two sampled suffix positions.
SAMPLE = 8
#: Occurrences that are located at a time.
LOCATE = 2_000_000

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: ASCII letters and digits, and all bytes of characters beyond ASCII.
_IS_WORD = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


@dataclass
class Words:
    """The lower-cased words of texts: where each stands, and the number of words before each text."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        data, starts = text_buffer(texts)
        data = _LOWER[data]
        return cls(data, *word_spans(data, starts, _IS_WORD))

    def hashes(self, seed: int) -> np.ndarray:
        return hash_words(self.data, self.begin, self.end, seed)


@dataclass
class Alphabet:
    """Distinct words, sorted by a hash that tells them apart; a text's words are compared by bytes."""

    data: np.ndarray  #: the words back to back
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    seed: int

    @classmethod
    def of(cls, words: Words) -> Alphabet:
        _, first, _ = distinct_words(words.data, words.begin, words.end)
        distinct = [words.data[b:e] for b, e in zip(words.begin[first], words.end[first], strict=True)]
        size = np.array([len(w) for w in distinct], np.int64)
        data = np.concatenate([np.zeros(0, np.uint8), *distinct])
        end = np.cumsum(size)
        seed = 1
        while len(np.unique(hashes := hash_words(data, end - size, end, seed))) < len(distinct):
            seed += 1
        order = np.argsort(hashes)
        return cls(data, (end - size)[order], end[order], hashes[order], seed)

    def __len__(self) -> int:
        return len(self.hashes)

    def symbols(self, words: Words) -> np.ndarray:
        """The place of each word in the alphabet, -1 for another word."""
        if not len(self):
            return np.full(len(words.begin), -1)
        hashes = words.hashes(self.seed)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        known = np.flatnonzero(self.hashes[at] == hashes)
        own = at[known]
        same = same_words(words.data, words.begin[known], words.end[known], self.data, self.begin[own], self.end[own])
        out = np.full(len(at), -1)
        out[known[same]] = own[same]
        return out


@dataclass
class Phrases:
    """Distinct phrases over the alphabet of the benchmark's words, and the items that have them."""

    alphabet: Alphabet  #: symbol 0 is no word, k + 1 the k-th
    symbols: np.ndarray  #: one row per phrase, filled from the right, 0 on the left
    length: np.ndarray
    item_from: np.ndarray  #: phrase k is in items[item_from[k]:item_from[k + 1]]
    items: np.ndarray
    names: list  #: id of each item as text

    @classmethod
    def of(cls, names: list, texts: list, window: int) -> Phrases:
        words = Words.of(pa.array(texts, pa.string()))
        counts, alphabet = words.counts, Alphabet.of(words)
        symbols = (alphabet.symbols(words) + 1).astype(np.int32)
        size = np.diff(counts)
        # A window begins at every word with enough words of its item behind it; a short item is one window.
        own = np.repeat(np.arange(len(texts)), size)
        left = counts[own + 1] - np.arange(len(own))
        begin = np.flatnonzero((left >= window) | (left == np.minimum(size, window)[own]))
        length = np.minimum(left[begin], window)
        if not len(begin):
            return cls(alphabet, np.zeros((0, window), np.int32), *(np.zeros(n, np.int64) for n in (0, 1, 0)), names)
        back = np.arange(window) - window + length[:, None]  # filled from the right
        rows = np.where(back >= 0, symbols[np.maximum(begin[:, None] + back, 0)], np.int32(0))
        del back
        item = own[begin]
        phrases, phrase = np.unique(rows, axis=0, return_inverse=True)
        order = np.argsort(phrase.ravel(), kind="stable")
        item_from = np.searchsorted(phrase.ravel()[order], np.arange(len(phrases) + 1))
        return cls(alphabet, phrases, (phrases > 0).sum(axis=1), item_from, item[order], names)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling; a suffix ends at its first 0, and equal ones stand as in the text."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        new = np.ones(n, bool)
        new[1:] = rank[order[1:]] != rank[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        # Ranks below n fit, so one number holds both halves.
        rank = rank * (n + 1) + follow
        order = np.argsort(rank, kind="stable")
        step *= 2


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Ranks of symbols: one bit vector per binary digit, each level sorted by the digits above."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = []
        for digit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            bits = (symbols >> digit) & 1
            zeros = int((bits == 0).sum())
            self.levels.append((digit, Bits(bits), zeros))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before the position beside it."""
        low, at = np.zeros_like(at), at.copy()
        for digit, bits, zeros in self.levels:
            one = (symbol >> digit) & 1 == 1
            low_ones, ones = bits.rank(low), bits.rank(at)
            low = np.where(one, zeros + low_ones, low - low_ones)
            at = np.where(one, zeros + ones, at - ones)
        return at - low

    def get(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(at), np.int64), at.copy()
        for digit, bits, zeros in self.levels:
            one = bits.get(at)
            out |= one.astype(np.int64) << digit
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return out


class FmIndex:
    """Backward search and location of phrases in a text of symbols; 0 ends a stretch."""

    def __init__(self, text: np.ndarray, largest: int, sample: int = SAMPLE):
        order = suffix_order(text)
        before = text[order - 1].astype(np.int64)
        before[order == 0] = 0
        self.wavelet = Wavelet(before, largest)
        self.first = np.searchsorted(text[order], np.arange(largest + 2))
        # A stretch's first symbol is sampled, so no walk goes beyond its stretch.
        sampled = (order % sample == 0) | (before == 0)
        self.sampled = Bits(sampled)
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.first[-1], np.int64)
        for column in phrases.T[::-1]:
            go = np.flatnonzero((column > 0) & (low < high))
            symbol = column[go].astype(np.int64)
            low[go] = self.first[symbol] + self.wavelet.rank(symbol, low[go])
            high[go] = self.first[symbol] + self.wavelet.rank(symbol, high[go])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix: steps back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            found = self.sampled.get(rows)
            out[left[found]] = self.positions[self.sampled.rank(rows[found])] + steps
            left, rows = left[~found], rows[~found]
            symbol = self.wavelet.get(rows)
            rows = self.first[symbol] + self.wavelet.rank(symbol, rows)
            steps += 1
        return out


def search_shard(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Words before each document, start and end of each stretch of hit words, items of each document.

    The shard's alphabet is that of the phrases: any other word ends a stretch, as the end of a
    document does, and a stretch shorter than the shortest phrase can hold none, so it is left out.
    """
    words = Words.of(texts)
    n, counts, n_words = len(texts), words.counts, len(words.begin)
    nothing = counts, np.zeros(0, np.int64), np.zeros(0, np.int64), [[] for _ in range(n)]
    if not n_words or not len(phrases.symbols):
        return nothing
    symbol = phrases.alphabet.symbols(words)
    del words
    known = symbol >= 0
    start, end = runs(known)
    inner = counts[1:-1]
    cut = np.unique(inner[(inner > 0) & (inner < n_words)])
    cut = cut[known[cut] & known[cut - 1]]
    start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    long = end - start >= phrases.length.min()
    start, end = start[long], end[long]
    if not len(start):
        return nothing
    # Text positions of the stretches, each followed by a 0, and the word behind each position.
    size = end - start + 1
    at = np.cumsum(size) - size
    word = np.arange(int(size.sum())) - np.repeat(at - start, size)
    text = np.zeros(len(word), np.int64)
    inside = np.ones(len(word), bool)
    inside[at + size - 1] = False
    text[inside] = symbol[word[inside]] + 1
    index = FmIndex(text, len(phrases.alphabet))
    low, high = index.search(phrases.symbols)
    found = np.flatnonzero(low < high)
    number = high[found] - low[found]
    hits, pairs = [], []
    cuts = np.searchsorted(np.cumsum(number), np.arange(LOCATE, number.sum() + LOCATE, LOCATE), "left")
    begin = 0
    for stop in [*np.unique(np.minimum(cuts + 1, len(found)))]:
        part, count = found[begin:stop], number[begin:stop]
        begin = stop
        if not len(part):
            continue
        row = np.repeat(low[part] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        rows, back = np.unique(row, return_inverse=True)
        first = word[index.locate(rows)][back]
        phrase = np.repeat(part, count)
        hits.append(np.unique(np.stack([first, first + phrases.length[phrase]]), axis=1))
        doc = np.searchsorted(counts, first, "right") - 1
        pair = np.unique(np.stack([doc, phrase]), axis=1)
        many = phrases.item_from[pair[1] + 1] - phrases.item_from[pair[1]]
        item = np.repeat(phrases.item_from[pair[1]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pairs.append(np.unique(np.repeat(pair[0], many) * len(phrases.names) + phrases.items[item]))
    if not hits:
        return nothing
    hit = np.unique(np.concatenate(hits, axis=1), axis=1)
    mark = covered(hit[0], hit[1], n_words)
    start, end = runs(mark)
    cut = np.unique(inner[(inner > 0) & (inner < n_words)])
    cut = cut[mark[cut] & mark[cut - 1]]
    start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    named = [set() for _ in range(n)]
    for value in np.unique(np.concatenate(pairs)):
        name = phrases.names[value % len(phrases.names)]
        if name is not None:
            named[value // len(phrases.names)].add(name)
    return counts, start, end, [sorted(x) for x in named]


def _merge(spans: list[dict], start: list[int], end: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted([(s["start"], s["end"]) for s in spans] + list(zip(start, end, strict=True))):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("start", "end")]))),
    ]
)
_FOUND_ARROW = pa.struct(
    [("n_words", pa.int64()), ("items", pa.list_(pa.string())),
     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def _search(state: DataFrame, phrases: Phrases, text_col: str, keep: list[str], one_in: int | None) -> DataFrame:
    """One pass over (doc, found): all documents against the phrases, shard by shard."""
    kinds = {f.name: f for f in state.schema["doc"].dataType}
    doc_type = T.StructType([kinds[c] for c in keep])
    place = [f.name for f in state.schema["doc"].dataType]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            doc = whole.column("doc")
            for batch, texts in shards(whole, doc.field(place.index(text_col)).cast(pa.string()), SHARD_BYTES):
                counts, start, end, items = search_shard(texts, phrases)
                first, last = np.searchsorted(start, counts[:-1]), np.searchsorted(start, counts[1:])
                found = []
                for k, old in enumerate(batch.column("found").to_pylist()):
                    own = slice(first[k], last[k])
                    base = counts[k]
                    old = old or {"items": [], "spans": []}
                    spans = _merge(old["spans"], (start[own] - base).tolist(), (end[own] - base).tolist())
                    found.append(
                        {
                            "n_words": int(counts[k + 1] - base),
                            "items": sorted({*old["items"], *items[k]}),
                            "spans": [{"start": a, "end": b} for a, b in spans],
                        }
                    )
                doc = batch.column("doc")
                parts = [doc.field(place.index(c)) for c in keep]
                kept = pa.StructArray.from_arrays(parts, names=keep) if keep else doc
                out = pa.RecordBatch.from_arrays([kept, pa.array(found, _FOUND_ARROW)], names=["doc", "found"])
                if one_in is not None:
                    hit = [sum(s["end"] - s["start"] for s in f["spans"]) for f in found]
                    dirty = [h > 0 and one_in * h >= f["n_words"] for h, f in zip(hit, found, strict=True)]
                    out = out.filter(pa.array([not d for d in dirty]))
                yield out

    return state.mapInArrow(run, T.StructType([T.StructField("doc", doc_type), T.StructField("found", FOUND)]))


def _annotate(docs, benchmark, item_col, item_text, text_col, keep, window, one_in) -> DataFrame:
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text).cast("string").alias("text"))
    items = items.where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    every = docs.columns
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in every]).alias("doc"), F.lit(None).cast(FOUND).alias("found"))
    scratch = Scratch(docs.sparkSession, "decontam")
    for k in range(blocks):
        # Each block has a bounded share of the benchmark, so it may come to the driver.
        block = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k).collect() if blocks > 1 else items.collect()
        phrases = Phrases.of([r.name for r in block], [r.text for r in block], window)
        last = k == blocks - 1
        state = _search(state, phrases, text_col, keep if last else every, one_in if last else None)
        if not last and (k + 1) % CHAIN == 0:
            state = scratch.store(state, f"pass{k}")
    return state


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``items`` (ids as text) and ``spans``.

    Words are runs of letters and digits after A-Z is lower-cased; characters beyond ASCII count as
    letters. Every ``window`` consecutive words of an item are searched, and a shorter item as a whole.
    ``spans`` are the merged stretches of hit words, by word number, and ``items`` the items with a
    hit, sorted as strings.

    A NULL or empty text has no words and no hits; an item without words is not searched; an item
    with a NULL id marks words but is not named; equal items are all named. Repeated rows and rows
    without an id give a row each. Without documents or without items, nothing is found.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _annotate(docs, benchmark, item_col, item_text, "text", ["doc_id"], window, None)
    return found.select("doc.doc_id", "found.n_words", "found.items", "found.spans")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    one_in: int = 20,
) -> DataFrame:
    """The documents without a hit, or with less than one hit word in ``one_in``, with all columns."""
    found = _annotate(docs, benchmark, item_col, item_text, text_col, docs.columns, window, one_in)
    return found.select("doc.*")
