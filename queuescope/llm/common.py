"""Shared helpers: written intermediate tables, and words of many texts as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuescope.session import ensure_checkpoint_dir

#: ASCII white space: space, and tab to carriage return.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])


#: Bytes that Spark hands to a Python worker at a time while a table is stored.
BATCH_BYTES = 8_000_000


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Smaller Arrow batches than the session's, for steps that keep several copies of a text."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written to the shared folder of the session, so that no lost executor costs a rerun.

    The folder is a new one for each instance. It stays until ``spark.checkpoint.dir`` is cleared,
    because the caller's result may still read from it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        with batches_of(self.spark, BATCH_BYTES):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a stored table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: str, n: int):
    """crc32 of a column as text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column back to back, and the start of each text (one more at the end).

    NULL counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_table(members: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


IS_WORD = ~byte_table(BLANKS)


def word_spans(
    data: np.ndarray, starts: np.ndarray, is_word: np.ndarray, cuts: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Words as maximal runs of word bytes that cross no text border and none of the sorted ``cuts``.

    Returns the first byte of each word, the byte after its last, and the number of words before
    each text (one more at the end).
    """
    inside = is_word[data]
    if not inside.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(starts), np.int64)
    change = np.empty(len(data) + 1, bool)
    change[0], change[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    first = change[:-1] & inside
    last = change.copy()
    last[:-1] &= ~inside
    borders = starts[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    if cuts is not None:
        borders = np.concatenate([borders, cuts])
    joined = borders[inside[borders] & inside[borders - 1]]
    first[joined] = True
    last[joined] = True
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    return begin, end, np.searchsorted(begin, starts)


def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xD1B54A32D192ED03)
    return values ^ (values >> np.uint64(32))


#: Longest word that is hashed together with others; longer ones are hashed one by one.
SHORT_WORD = 64


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros follow the last."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _part(eights: np.ndarray, begin: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """Eight bytes of each word from its ``8 * k``-th on, zeros behind its end."""
    return eights[begin + 8 * k] & _FIRST_BYTES[np.minimum(length - 8 * k, 8)]


#: Words of up to so many bytes have the same hash only if they are the same.
SURE_WORD = 7


def hash_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands; no word is empty.

    Words of up to ``SURE_WORD`` bytes and their lengths are turned into a hash reversibly. Longer ones
    are mixed in parts of eight bytes, each part after the parts before it have been mixed; words over
    ``SHORT_WORD`` bytes get their XXH3. Hashes of another ``seed`` are independent.
    """
    length, eights = end - begin, _eights(data)
    start = np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    head = length.astype(np.uint64) << np.uint64(56)
    sure = length <= SURE_WORD
    out = mix((_part(eights, begin, length, 0) * sure | head) ^ start)
    now, k = np.flatnonzero(~sure & (length <= SHORT_WORD)), 0
    while len(now):
        out[now] = mix(out[now] ^ _part(eights, begin[now], length[now], k))
        k += 1
        now = now[length[now] > 8 * k]
    for i in np.flatnonzero(length > SHORT_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes(), seed)
    return out


def same_words(
    data: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray, other_begin: np.ndarray, other_end: np.ndarray
) -> np.ndarray:
    """Whether each word is the other word beside it; the two have the same hash."""
    length = end - begin
    out = length == other_end - other_begin
    ours, theirs = _eights(data), _eights(other)
    now, k = np.flatnonzero(out & (length > SURE_WORD) & (length <= SHORT_WORD)), 0
    while len(now):
        same = _part(ours, begin[now], length[now], k) == _part(theirs, other_begin[now], length[now], k)
        out[now[~same]] = False
        k += 1
        now = now[same & (length[now] > 8 * k)]
    for i in np.flatnonzero(out & (length > SHORT_WORD)).tolist():
        out[i] = np.array_equal(data[begin[i] : end[i]], other[other_begin[i] : other_end[i]])
    return out


def distinct_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and one place of each distinct word, and the number of every word's distinct word.

    Words are compared by their bytes, so distinct words may share a hash; hashes rise but for those.
    """
    hashes, first, of = np.unique(hash_words(data, begin, end), return_index=True, return_inverse=True)
    first_of = first[of]
    wrong = np.flatnonzero(~same_words(data, begin, end, data, begin[first_of], end[first_of]))
    if len(wrong):  # another word of the same hash
        known: dict[bytes, int] = {}
        places = []
        for i in wrong.tolist():
            word = data[begin[i] : end[i]].tobytes()
            if word not in known:
                known[word] = len(first) + len(known)
                places.append((hashes[of[i]], i))
            of[i] = known[word]
        hashes = np.concatenate([hashes, np.array([h for h, _ in places], np.uint64)])
        first = np.concatenate([first, [i for _, i in places]])
    return hashes, first, of


class KnownWords:
    """Words that a worker has seen, numbered in the order of their first sight; compared by bytes."""

    def __init__(self) -> None:
        #: Hashes, sorted, and the number of the word behind each; a hash stands for one word.
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: Word k is data[begin[k]:begin[k + 1]].
        self.data, self.begin = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.begin) - 1

    def numbers(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The number of each distinct word, and those that were new, in the order of their numbers.

        A word whose hash stands for another word is new each time.
        """
        out = np.full(len(keys), -1)
        taken = np.zeros(len(keys), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            taken = self.keys[at] == keys
            hit = np.flatnonzero(taken)
            known = self.number[at[hit]]
            same = same_words(data, begin[hit], end[hit], self.data, self.begin[known], self.begin[known + 1])
            out[hit[same]] = known[same]
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out, []
        new = [data[b:e].tobytes() for b, e in zip(begin[missing].tolist(), end[missing].tolist(), strict=True)]
        out[missing] = len(self) + np.arange(len(new))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(end[missing] - begin[missing])])
        self.data = np.concatenate([self.data, np.frombuffer(b"".join(new), np.uint8)])
        free = missing[~taken[missing]]
        free = free[np.unique(keys[free], return_index=True)[1]]  # in the order of their keys
        at = np.searchsorted(self.keys, keys[free])
        self.keys, self.number = np.insert(self.keys, at, keys[free]), np.insert(self.number, at, out[free])
        return out, new


def window_hashes(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes; element i covers i to i+size-1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = _byte_values(seed + 1000)[:size] | np.uint64(1) if size <= 256 else None
    if factors is None:
        factors = np.random.default_rng(seed).integers(1, 2**63, size, dtype=np.uint64) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k : k + n] * factors[k]
    return mix(out)


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the number of each value's group, and the size of each group."""
    order = np.argsort(values)
    values = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    group = np.empty(len(values), np.int32)
    group[order] = np.cumsum(new, dtype=np.int32) - 1
    del order
    return values[new], group, np.diff(np.append(np.flatnonzero(new), len(values)))


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in at least one of the spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true values."""
    padded = np.concatenate(([False], flags, [False]))
    change = np.flatnonzero(padded[1:] != padded[:-1])
    return change[::2], change[1::2]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` stored with a number for each row, and the name of that column.

    The numbers are fixed by writing them; later steps may read the table as often as they like.
    """
    row = fresh(docs, "row_")
    return scratch.store(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def keep_rows(rows: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows whose number is in ``kept``, without the number."""
    return rows.join(kept, row, "left_semi").drop(row)


def shards(batch: pa.RecordBatch, texts: pa.Array, size: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Consecutive parts of a batch with up to ``size`` bytes of text, at least one row each."""
    starts = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + size, "right")) - 1)
        yield batch.slice(at, upto - at), texts.slice(at, upto - at)
        at = upto
    # Arrow keeps freed memory for later; a task that waits for its next batch should not hold it.
    pa.default_memory_pool().release_unused()


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, over tasks."""
    import sys
    import types

    return sys.modules.setdefault("queuescope_worker_state", types.ModuleType("state")).__dict__


# --- Chunks: stored texts that a later step reads again together with what was found for them ---


def _chunk_bytes(ids: pa.Array, texts: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays([ids, texts], names=["id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def open_chunk(data: bytes) -> tuple[pa.Array, pa.Array]:
    """Ids and texts of a chunk."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table.column("id").combine_chunks(), table.column("text").combine_chunks()


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """(chunk, size, words, data): texts of a task in parts of up to ``size`` bytes, compressed.

    ``docs`` has an id and a text. ``words`` counts the runs of other characters than ASCII blanks.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch, texts in shards(whole, whole.column(1), size):
                data, starts = text_buffer(texts)
                words = len(word_spans(data, starts, IS_WORD)[0])
                row = [number, len(data), words]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([v], pa.int64()) for v in row), pa.array([_chunk_bytes(batch.column(0), texts)], pa.binary())],
                    names=["chunk", "size", "words", "data"],
                )
                number += 1

    return docs.mapInArrow(cut, "chunk long, size long, words long, data binary")


def bits_for(rows: int, size: int) -> int:
    """The binary logarithm of a number of buckets with about ``size`` rows each."""
    return max(0, (max(1, rows) // size)).bit_length()
