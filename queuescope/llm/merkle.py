"""Merkle manifest of a dataset: bitmap ranks place the leaves, keyed slot arrays reduce the levels."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuescope.llm.common import Scratch

#: Ids of one bitmap (at least 6 bits), containers of one node of the directory above, and leaves of one slot array; all as bits.
CONTAINER_BITS = 12
DIRECTORY_BITS = 10
SLOT_BITS = 12

#: Leaves without an id take the first places of a tree, by so many leading bits of their digest.
_NO_ID_BITS = 24


def field(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Digest of a row's values, each written so that no two rows read alike."""
    return F.sha2(F.concat(*map(field, values)), 256)


def h(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(size: int) -> int:
    """Steps of pairing up that leave one of ``size`` nodes."""
    return max(0, int(size) - 1).bit_length()


# --- Bitmaps: which ids a container has ---


def pack_lows(lows: np.ndarray) -> tuple[bytes | None, bytes]:
    """A container's low bits: few as a list, many as a bitmap and a list of those that repeat."""
    size = 1 << CONTAINER_BITS
    if len(lows) < size // 16:
        return None, lows.astype("<u2").tobytes()
    number = np.bincount(lows, minlength=size)
    again = np.repeat(np.arange(size), np.maximum(number - 1, 0))
    return np.packbits(number > 0, bitorder="little").tobytes(), again.astype("<u2").tobytes()


class Container:
    """A merged bitmap with a directory of its population counts."""

    def __init__(self, bits: bytes, directory: bytes, again: bytes, number: bytes):
        self.words = np.frombuffer(bits, "<u8")
        self.directory = np.frombuffer(directory, "<u2").astype(np.int64)
        #: Ids of more than one leaf, and how many more leaves than one the ids before have.
        self.again = np.frombuffer(again, "<u2")
        self.before = np.concatenate(([0], np.cumsum(np.frombuffer(number, "<i8"))))

    @staticmethod
    def merge(pieces: list[tuple[bytes | None, bytes]]) -> dict:
        size = 1 << CONTAINER_BITS
        number = np.zeros(size, np.int64)
        for bits, lows in pieces:
            if bits is not None:
                number += np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
            number += np.bincount(np.frombuffer(lows, "<u2"), minlength=size)
        packed = np.packbits(number > 0, bitorder="little")
        words = np.bitwise_count(packed.view("<u8")).astype(np.int64)
        again = np.flatnonzero(number > 1)
        return {
            "bits": packed.tobytes(),
            "directory": (np.cumsum(words) - words).astype("<u2").tobytes(),
            "again": again.astype("<u2").tobytes(),
            "number": (number[again] - 1).astype("<i8").tobytes(),
            "leaves": int(number.sum()),
        }

    def rank(self, lows: np.ndarray) -> np.ndarray:
        """Leaves of smaller ids in the container."""
        word, bit = lows >> 6, (lows & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.directory[word] + np.bitwise_count(below) + self.before[np.searchsorted(self.again, lows)]


def _addressed(leaves: DataFrame) -> DataFrame:
    """``leaves`` with the container of each and its place there, both in the order of ids, NULL first."""
    place = F.col("id").bitwiseXOR(F.lit(-(1 << 63)))
    no_ids = 1 << (_NO_ID_BITS - CONTAINER_BITS)
    leading = F.conv(F.substring(F.hex("leaf"), 1, _NO_ID_BITS // 4), 16, 10).cast("long")
    mask = F.lit((1 << CONTAINER_BITS) - 1).cast("long")
    no_id = F.col("id").isNull()
    return leaves.withColumns(
        {
            "container": F.when(no_id, F.shiftright(leading, CONTAINER_BITS)).otherwise(
                F.shiftrightunsigned(place, CONTAINER_BITS) + no_ids
            ),
            "low": F.when(no_id, leading.bitwiseAND(mask)).otherwise(place.bitwiseAND(mask)).cast("int"),
        }
    )


def _containers(leaves: DataFrame) -> DataFrame:
    """Each container once: every task packs what it has, and the packed bitmaps are merged."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for (tree, container), own in batch.to_pandas().groupby(["tree", "container"], sort=False)["low"]:
                rows.append((tree, container, *pack_lows(own.to_numpy())))
            names, kinds = ["tree", "container", "bits", "lows"], [pa.string(), pa.int64(), pa.binary(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        found = Container.merge(list(zip(group["bits"], group["lows"], strict=True)))
        return pd.DataFrame([{"tree": group["tree"].iloc[0], "container": group["container"].iloc[0], **found}])

    packed = leaves.select("tree", "container", "low").mapInArrow(pack, "tree string, container long, bits binary, lows binary")
    return packed.groupBy("tree", "container").applyInPandas(
        merge, "tree string, container long, bits binary, directory binary, again binary, number binary, leaves long"
    )


def _offsets(containers: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Leaves before each container of its tree, and the size of each tree.

    Counts go up a directory of ``2**DIRECTORY_BITS``-way nodes until each tree has a single one, and
    the sums before come down again, so no window is larger than one node.
    """
    level = containers.select("tree", F.col("container").alias("at"), "leaves")
    steps = []
    while True:
        up = level.withColumn("up", F.shiftright("at", DIRECTORY_BITS))
        inside = Window.partitionBy("tree", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("leaves").over(inside), F.lit(0).cast("long"))
        steps.append(scratch.store(up.select("tree", "at", "up", "leaves", before.alias("before")), f"directory{len(steps)}"))
        level = steps[-1].groupBy("tree", F.col("up").alias("at")).agg(F.sum("leaves").alias("leaves"))
        nodes, trees = level.agg(F.count("*"), F.count_distinct("tree")).first()
        if nodes == trees:
            break
    offsets = steps.pop().select("tree", "at", "before")
    while steps:
        above = offsets.select("tree", F.col("at").alias("up"), F.col("before").alias("base"))
        offsets = steps.pop().join(above, ["tree", "up"]).select("tree", "at", (F.col("before") + F.col("base")).alias("before"))
    return offsets.withColumnRenamed("at", "container"), level.select("tree", F.col("leaves").alias("size"))


def _placed(leaves: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with their ``place`` in the tree and its ``size``; and (tree, size)."""
    addressed = scratch.store(_addressed(leaves), "addressed")
    containers = scratch.store(_containers(addressed), "containers")
    offsets, sizes = _offsets(containers, scratch)
    sizes = scratch.store(sizes, "sizes")
    known = containers.join(offsets, ["tree", "container"]).join(sizes, "tree")
    kept = [c for c in addressed.columns if c not in ("container", "low")]

    def rank(rows: pd.DataFrame, containers: pd.DataFrame) -> pd.DataFrame:
        own = containers.iloc[0]
        container = Container(own["bits"], own["directory"], own["again"], own["number"])
        lows = rows["low"].to_numpy()
        place = own["before"] + container.rank(lows)
        many = np.isin(lows, container.again)
        if many.any():  # leaves that share an id stand by their digest
            same = rows.loc[many, ["low", "leaf"]].sort_values(["low", "leaf"])
            extra = pd.Series(0, rows.index)
            extra[same.index] = same.groupby("low").cumcount()
            place = place + extra.to_numpy()
        return rows[kept].assign(place=place, size=own["size"])

    schema = ", ".join(f"{name} {kind}" for name, kind in addressed.dtypes if name in kept)
    by = ["tree", "container"]
    placed = addressed.groupBy(*by).cogroup(known.groupBy(*by)).applyInPandas(rank, f"{schema}, place long, size long")
    return scratch.store(placed, "placed"), sizes


def _in_order(trees: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, tree_place): trees numbered in the order of their names.

    Names are sorted over all tasks; a row per task says how many stand before it.
    """
    at = scratch.store(trees.orderBy("tree").withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33)
    parts = at.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    inside = F.col("at") - F.shiftleft("part", 33)
    return at.withColumn("part", part).join(F.broadcast(parts), "part").select(
        "tree", (F.col("before") + inside).cast("long").alias("tree_place")
    )


# --- Slot arrays: consecutive nodes of a tree, reduced in one task ---


def _steps(size: int, rounds_done: int) -> int:
    """Levels that a slot array reduces in a round."""
    return max(0, min(SLOT_BITS, _levels(size) - SLOT_BITS * rounds_done))


def _reduced(slots: list[str], steps: int) -> list[list[str]]:
    """The slots and each level above them; a node without a partner is hashed alone."""
    levels = [slots]
    for _ in range(steps):
        low = levels[-1]
        levels.append([h(*low[k : k + 2]) for k in range(0, len(low), 2)])
    return levels


def _slots(group: pd.DataFrame) -> list[str]:
    """Nodes by their place; each writes its own slot."""
    slots = [""] * len(group)
    for k, node in zip((group["place"] & ((1 << SLOT_BITS) - 1)).tolist(), group["node"], strict=True):
        slots[k] = node.hex()
    return slots


def _reduce(done: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Makes the node above one slot array, after so many rounds."""

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        top = _reduced(_slots(group), _steps(first["size"], done))[-1][0]
        place = int(first["place"]) >> SLOT_BITS
        return pd.DataFrame({"tree": [first["tree"]], "size": first["size"], "place": place, "node": [bytes.fromhex(top)]})

    return reduce


def _tell(done: int, told: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Gives the nodes of one slot array their siblings, then what is above the array."""

    def tell(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = above.iloc[0]
        levels = _reduced(_slots(group), _steps(group["size"].iloc[0], done))[:-1]
        paths = []
        for k in (group["place"] & ((1 << SLOT_BITS) - 1)).tolist():
            siblings = []
            for level in levels:
                if k ^ 1 < len(level):
                    siblings.append(level[k ^ 1])
                k >>= 1
            paths.append(bytes.fromhex("".join(siblings)) + own["path"])
        return group.drop(columns="array").assign(path=paths, **{c: [own[c]] * len(group) for c in told})

    return tell


def _up(nodes: DataFrame, largest: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """(tree, size, place, node) of each round; the last has the roots of all trees."""
    rounds = [nodes]
    while largest > 1:
        done = len(rounds) - 1
        array = F.shiftright("place", SLOT_BITS)
        groups = rounds[-1].select("tree", "size", "place", "node").groupBy("tree", array)
        up = groups.applyInPandas(_reduce(done), "tree string, size long, place long, node binary")
        rounds.append(scratch.store(up, f"{name}{done + 1}"))
        largest = (largest - 1 >> SLOT_BITS) + 1
    return rounds


def _down(rounds: list[DataFrame], tops: DataFrame, told: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The nodes of the first round with ``path``, their siblings up to the top, and the columns ``told`` of the tree.

    ``tops`` has (tree, place 0, path, ...told): what is above the tree's root.
    """
    kinds = dict(tops.dtypes)
    for done in range(len(rounds) - 2, -1, -1):
        nodes = rounds[done]
        columns = [*nodes.dtypes, ("path", "binary"), *[(c, kinds[c]) for c in told]]
        schema = ", ".join(f"{c} {k}" for c, k in columns)
        left = nodes.withColumn("array", F.shiftright("place", SLOT_BITS)).groupBy("tree", "array")
        right = tops.select("tree", F.col("place").alias("array"), "path", *told).groupBy("tree", "array")
        tops = left.cogroup(right).applyInPandas(_tell(done, told), schema)
        if done:
            tops = scratch.store(tops, f"{name}{done}")
    if len(rounds) == 1:  # every tree is a single node
        tops = rounds[0].join(tops.drop("place"), "tree")
    return tops


def manifest(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """The leaves of (tree, id, leaf, ...) in their trees, and the trees in one above them.

    ``tree`` names the tree of a leaf, ``id`` is a whole number, ``leaf`` the binary digest. In a tree,
    leaves stand by ascending id; while there is more than one node, every two neighbours become the
    digest of their hexadecimal digests, and a last one without a neighbour becomes its own. The roots
    of the trees, by the trees' names, are reduced in the same way.

    Adds ``place`` and ``size`` (of the leaf in its tree), ``tree_place`` and ``trees``, ``path`` (the
    binary digests of all siblings up to the root, from below), ``subroot`` and ``root``.

    Bitmaps of the ids, merged from all tasks, say how many smaller ids a tree has: that is a leaf's
    place, and nothing is sorted. Slot arrays of ``2**SLOT_BITS`` consecutive nodes are reduced in one
    task each, however large a tree is.

    A NULL id comes before all others, by digest; leaves that share an id stand by their digest, in
    one task. Repeated rows are leaves of their own. NULL is no tree name. No leaves give no rows.
    """
    placed, sizes = _placed(leaves, scratch)
    largest, trees = sizes.agg(F.max("size"), F.count("*")).first()
    if not trees:
        none = F.lit(None).cast("binary")
        return placed.withColumns({"tree_place": F.lit(0).cast("long"), "trees": F.lit(0).cast("long"), "path": none, "subroot": none, "root": none})
    rounds = _up(placed.withColumnRenamed("leaf", "node"), largest, scratch, "up")
    subroots = rounds[-1].select("tree", "node").join(_in_order(sizes.select("tree"), scratch), "tree")
    above = subroots.select(
        F.lit("").alias("tree"), F.lit(trees).cast("long").alias("size"), F.col("tree_place").alias("place"), "node", F.col("tree").alias("name")
    )
    top_rounds = _up(scratch.store(above, "subroots"), trees, scratch, "top")
    empty = F.lit(b"").cast("binary")
    tops = top_rounds[-1].select("tree", F.lit(0).cast("long").alias("place"), empty.alias("path"), F.col("node").alias("root"))
    told = _down(top_rounds, tops, ["root"], scratch, "top-path")
    told = told.select(
        F.col("name").alias("tree"),
        F.lit(0).cast("long").alias("place"),
        "path",
        F.col("node").alias("subroot"),
        F.col("place").alias("tree_place"),
        F.col("size").alias("trees"),
        "root",
    )
    found = _down(rounds, scratch.store(told, "tops"), ["subroot", "tree_place", "trees", "root"], scratch, "path")
    return found.withColumnRenamed("node", "leaf")


def fold_up(node: str, siblings: str, sizes: list[tuple[int, int]]) -> str:
    """The root that a leaf and its siblings give; ``sizes`` are (place, nodes) in each tree on the way."""
    at = 0
    for place, size in sizes:
        while size > 1:
            if place & 1:
                node = h(siblings[at : at + 64], node)
                at += 64
            elif place + 1 < size:
                node = h(node, siblings[at : at + 64])
                at += 64
            else:
                node = h(node)
            place, size = place >> 1, size + 1 >> 1
    return node


def fold(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows of a manifest with ``name``, the root recomputed from the digest in ``column`` and the row's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            columns = [read(c) for c in (column, "path", "place", "size", "tree_place", "trees")]
            roots = [
                bytes.fromhex(fold_up(node.hex(), path.hex(), [(place, size), (tree, trees)]))
                for node, path, place, size, tree, trees in zip(*columns, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, `{name}` binary")


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, id, leaf, tampered) of the rows of ``documents``, one tree for each language, NULL first.

    ``tampered`` is the digest of the row with one more in ``n_chars``, for the rows whose id's crc32 is
    divisible by 7 and whose ``n_chars`` is no NULL; for all others it is NULL.
    """
    id_, n = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    values = [id_, F.col("source"), F.col("lang"), n, F.col("text")]
    more = [*values[:3], n.cast("decimal(20,0)") + 1, values[4]]
    hit = (F.crc32(id_.cast("string").cast("binary")) % 7 == 0) & n.isNotNull()
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("tree"),
        id_.alias("id"),
        F.unhex(leaf(*values)).alias("leaf"),
        F.when(hit, F.unhex(leaf(*more))).alias("tampered"),
    )
