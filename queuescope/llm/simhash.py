"""SimHash near-dedup by one-wildcard segment variants."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.llm.common import Scratch, keep_rows, mix, numbered

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42

#: Distinct fingerprints of one variant that meet in one task, on average.
BUCKET_ROWS = 250_000
#: Runs of equal keys up to this length are compared pair by pair, longer ones by growing groups.
SHORT_RUN = 48

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 majority bits over the hashes of all shingles; 0 for a text without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(size, len(words))
    begins = [0, *(ends[: len(words) - size] + 1).tolist()]
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(begins), 255 * 256):
        part = [digest(joined[b:e], seed) for b, e in zip(begins[at : at + 65280], ends[at : at + 65280], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of up to 255 bits fit a byte
        votes += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        votes += bits[whole:].sum(axis=0, dtype=np.uint8)
    majority = np.packbits(votes * 2 > len(begins), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, row: str, size: int) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), pa.array(values.view(np.int64))], names=["row", "id", "fp"]
            )

    narrow = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), row)
    return narrow.mapInArrow(score, "row long, id long, fp long")


def variants(distance: int) -> list[tuple[int, int]]:
    """(segment, kept bits) of each one-wildcard variant.

    With ``distance // 2 + 1`` segments, two fingerprints within the distance differ in at most one
    bit of at least one segment, so they agree on a variant that leaves this bit out.
    """
    segments = distance // 2 + 1
    edges = [64 * k // segments for k in range(segments + 1)]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        segment = ((1 << high) - 1) ^ ((1 << low) - 1)
        out += [(segment, segment ^ (1 << bit)) for bit in range(low, high)]
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches over the links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            return label


def _grow(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each value to the first of its group; grouped values are not compared again."""
    left, roots, nodes = values, [], []
    while len(left):
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= distance
            if near.any():
                found, left = left[near], left[~near]
                frontier.extend(found)
                nodes.append(found)
                roots.append(np.full(len(found), root))
    if not nodes:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(roots), np.concatenate(nodes)


def links_of(values: np.ndarray, segment: int, kept: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links, as a forest, among distinct values that agree on the kept bits."""
    values = np.sort(values)
    keys = values & np.uint64(kept)
    order = np.argsort(keys, kind="stable")
    values, keys = values[order], keys[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    length = np.diff(new)
    a, b = [], []
    for at in np.flatnonzero(length > SHORT_RUN):
        root, node = _grow(values[new[at] : new[at + 1]], distance)
        a.append(root)
        b.append(node)
    short = np.repeat((length > 1) & (length <= SHORT_RUN), length)
    values, keys = values[short], keys[short]
    wildcard = np.uint64(segment ^ kept)
    lowest = segment & -segment == int(wildcard)
    first, second = [], []
    for step in range(1, SHORT_RUN):
        same = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(same):
            break
        differ = values[same] ^ values[same + step]
        near = np.bitwise_count(differ) <= distance
        # Equal in the whole segment: a matter of its first variant only.
        if not lowest:
            near &= (differ & wildcard) != 0
        first.append(same[near])
        second.append(same[near] + step)
    if first:
        i, j = np.concatenate(first), np.concatenate(second)
        label = _forest(i, j, len(values))
        node = np.flatnonzero(label != np.arange(len(values)))
        a.append(values[label[node]])
        b.append(values[node])
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, rows: int, distance: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints within the distance.

    ``distinct`` has each fingerprint once, so copies weigh nothing here. Each fingerprint goes to
    one bucket of every variant, by the kept bits of the segment. A bucket returns a spanning forest
    of its links, never all pairs of a group.
    """
    ways = variants(distance)
    buckets = 1
    while rows > buckets * BUCKET_ROWS:
        buckets *= 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            way, bucket, packed = [], [], []
            for k, (_, kept) in enumerate(ways):
                target = (mix(values & np.uint64(kept)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(target, kind="stable")
                cuts = np.searchsorted(target[order], np.arange(buckets + 1))
                for j in np.flatnonzero(cuts[1:] > cuts[:-1]):
                    way.append(k)
                    bucket.append(j)
                    packed.append(values[order[cuts[j] : cuts[j + 1]]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(way, pa.int32()), pa.array(bucket, pa.int64()), pa.array(packed, pa.binary())],
                names=["way", "bucket", "fps"],
            )

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.frombuffer(x, np.uint64) for x in group["fps"]])
        a, b = links_of(values, *ways[group["way"].iloc[0]], distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "way int, bucket long, fps binary")
    return dealt.groupBy("way", "bucket").applyInPandas(meet, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every linked node, root included: alternating large and small stars.

    A round replaces links by links to the smallest neighbour, which keeps components as they are;
    every step is a minimum per node and an equality join. The minima are stored, so that the join
    deals out the links anew and adaptive execution can split those of a hub. The rounds end when the links no longer change, each component then being one star.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = scratch.store(edges.select(low, high).where("a <> b").distinct(), "edges0")
    mark = None
    for k in count(1):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = scratch.store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"least{k}")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = scratch.store(large.where("a <> b").distinct(), f"large{k}")
        least = scratch.store(large.groupBy("b").agg(F.min("a").alias("m")), f"smallest{k}")
        joined = large.join(least, "b")
        small = joined.select("m", "a").union(joined.select("m", "b")).toDF("a", "b")
        edges = scratch.store(small.where("a <> b").distinct(), f"edges{k}")
        for old in (f"least{k}", f"large{k}", f"smallest{k}", f"edges{k - 1}"):  # the new links stand for them
            scratch.drop(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select("a", "a").distinct()
    )


def _classes(docs: DataFrame, id_col: str, text_col: str, row: str, size: int, distance: int, scratch: Scratch) -> DataFrame:
    """(row, id, fp, best): best is the smallest (no id, id, row) of the component."""
    prints = scratch.store(fingerprints(docs, id_col, text_col, row, size), "fingerprints")
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    distinct = scratch.store(prints.groupBy("fp").agg(F.min(own).alias("best"), F.count("*").alias("n")), "distinct")
    stars = components(links(distinct, distinct.count(), distance), scratch)
    stars = scratch.store(stars, "stars")
    member = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").where("root IS NOT NULL OR n > 1")
    member = member.withColumn("root", F.coalesce("root", "fp"))
    best = member.groupBy("root").agg(F.min("best").alias("best"))
    classes = scratch.store(member.select("fp", "root").join(best, "root").select("fp", "best"), "classes")
    # Each fingerprint is in ``classes`` once; adaptive execution splits the rows of a hot one.
    return prints.join(classes, "fp", "left").select("row", "id", "fp", F.coalesce("best", own).alias("best"))


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint``, ``component_id``.

    A-Z are lower-cased, words are split at ASCII white space, and the XXH64 of every shingle, repeats
    included, votes on 64 bits; a text with fewer words is one shingle, one without words has
    fingerprint 0. Documents with fingerprints within ``max_distance`` bits are linked, and
    ``component_id`` is the smallest id that links reach.

    Ids are whole numbers. A NULL text has no words. A NULL id is larger than all others, so it names a component only where
    no document has an id. Repeated rows share a fingerprint. An empty table gives an empty result.
    Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).withColumn(
        "row_", F.monotonically_increasing_id()
    )
    return _classes(rows, "id_", "text_", "row_", shingle_words, max_distance, scratch).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.id").alias("component_id"),
    )


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """One row of each component, that with the smallest id, with all columns of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows, row = numbered(docs, scratch)
    classes = _classes(rows, id_col, text_col, row, shingle_words, max_distance, scratch)
    kept = classes.where("best.row = row").select(F.col("row").alias(row))
    return keep_rows(rows, row, kept)
