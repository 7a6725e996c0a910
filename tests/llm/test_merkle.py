import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from queuescope.llm import merkle, queries
from queuescope.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place int, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    values = [doc_id, source, lang, n_chars, text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves):
    """Root, and (sibling hashes, their sides) of each leaf."""
    paths = [[] for _ in leaves]
    own = [[k] for k in range(len(leaves))]
    nodes = list(leaves)
    while len(nodes) > 1:
        for k in range(0, len(nodes) - 1, 2):
            for i in own[k]:
                paths[i].append((nodes[k + 1], "right"))
            for i in own[k + 1]:
                paths[i].append((nodes[k], "left"))
        if len(nodes) % 2:
            for i in own[-1]:
                paths[i].append(("", "alone"))
        own = [sum(own[k : k + 2], []) for k in range(0, len(own), 2)]
        nodes = [sha(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return nodes[0], paths


def plain_fold(node, path):
    for other, side in path:
        node = sha(node, other) if side == "right" else sha(other, node)
    return node


def plain(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        own = sorted((r[0] is not None, r[0] or 0, plain_leaf(*r), r) for r in langs[lang])
        trees[lang] = ([x[2] for x in own], [x[3] for x in own], *plain_tree([x[2] for x in own]))
    root, above = plain_tree([trees[x][2] for x in order])
    out = []
    for k, lang in enumerate(order):
        leaves, own, subroot, paths = trees[lang]
        for leaf, r, path in zip(leaves, own, paths):
            path = path + above[k]
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = plain_fold(plain_leaf(*r[:4], r[4] + 1) if bad else leaf, path)
            out.append((r[0], leaf, subroot, root, sha(*[p[0] for p in path]), folded, folded == root))
    return sorted(out, key=str)


def rows_of(frame):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r[c] for c in names) for r in frame.collect()], key=str)


@pytest.mark.parametrize("container, slots", [(6, 2), (12, 12), (8, 3)])
def test_matches_brute_force(spark, monkeypatch, container, slots):
    monkeypatch.setattr(merkle, "CONTAINER_BITS", container)
    monkeypatch.setattr(merkle, "SLOT_BITS", slots)
    monkeypatch.setattr(merkle, "DIRECTORY_BITS", 3)
    rng = random.Random(3)
    rows = [(k * 3 - 90, f"text {k}", rng.choice(["en", "de", "é", None, "", "-"]), None if k % 5 else "s", k if k % 9 else None) for k in range(130)]
    rows += [(None, "no id", "en", "s", 1), (None, None, "en", None, None), (1 << 62, "日本" * 3, "en", "", 4), (-(1 << 63), "", "en", "s", 0)]
    rows += [(5, "one of two", "en", "s", 1), (5, "the other", "en", "s", 1), ((1 << 63) - 1, "x" * 100_000, "lone", "s", (1 << 63) - 1)]
    rows += rows[:15] + [(70_000, "hot", "de", "s", 3)] * 40
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    assert rows_of(queries.document_manifest(frame)) == plain(rows)


def test_tree_sizes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SLOT_BITS", 2)
    rows = [(100 * n + k, str(k), f"of {n}", "s", 1) for n in (1, 2, 3, 4, 5, 8, 9, 16, 17) for k in range(n)]
    assert rows_of(queries.document_manifest(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))) == plain(rows)


def test_single_leaf(spark):
    rows = [(1, "a", None, "s", 1)]
    assert rows_of(queries.document_manifest(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))) == plain(rows)


def test_empty_table(spark):
    assert queries.document_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_places_are_ranks(spark):
    rng = random.Random(9)
    ids = rng.sample(range(200_000), 9_000) + rng.sample(range(-(1 << 60), 1 << 60), 50)
    leaves = spark.createDataFrame([("t", i, hashlib.sha256(str(i).encode()).digest()) for i in ids], "tree string, id long, leaf binary")
    got = {r.id: r.place for r in merkle.manifest(leaves, Scratch(spark, "merkle")).select("id", "place").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


def test_bitmaps_of_few_and_many(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    pieces = [rng.integers(0, 4096, n) for n in (3, 2000, 300, 0)]
    made = merkle.Container.merge([merkle.pack_lows(p) for p in pieces])
    whole = np.sort(np.concatenate(pieces))
    own = merkle.Container(made["bits"], made["directory"], made["again"], made["number"])
    assert made["leaves"] == len(whole)
    assert own.rank(np.arange(4096)).tolist() == np.searchsorted(whole, np.arange(4096)).tolist()


def test_tampered_rows_are_found(spark):
    rows = [(k, "text", "en", "s", 5) for k in range(200)]
    got = queries.document_manifest(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
    bad = {r.doc_id for r in got.where(~F.col("verified")).collect()}
    assert bad == {k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 0}
