"""The stages against plain versions on a small corpus; packing by its tokens."""

import random
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from queuescope.llm import langid, queries
from tests.llm.test_decontam import plain as plain_hits
from tests.llm.test_simhash import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = {k: None for k in (0x20, *range(9, 14))}


def corpus():
    rng = random.Random(6)
    words = {
        "en": ["the", "and", "with", "house", "water", "this", "that", "from", "which", "would"],
        "de": ["der", "und", "nicht", "schön", "über", "straße", "ein", "auch", "wird", "zwischen"],
    }
    passage = " ".join(f"item{rng.randrange(1000)} quiz{rng.randrange(1000)}" for _ in range(12))
    rows = []
    for k in range(160):
        lang = "en" if k % 3 else "de"
        text = " ".join(rng.choice(words[lang]) + (str(rng.randrange(9)) if rng.random() < 0.3 else "") for _ in range(rng.randint(8, 120)))
        rows.append([k, text, lang, "s", len(text)])
    rows[7][1] = rows[3][1].replace(" ", "\n")
    rows[9][1] = rows[4][1] + "  "
    rows[12][1] = " ".join([*rows[15][1].split(), "extra"])
    rows[20][1] = rows[21][1][:60] + " " + passage
    rows[22][1] = passage.upper()
    rows += [[500, None, None, None, None], [501, "", "en", "s", 0], [502, "123 456", "en", "s", 7], [None, "the and with this " * 9, None, "s", 1]]
    return rows, [(1, passage), (2, None), (3, "")]


def plain_kept(rows, bench, network):
    import pyarrow as pa

    names, score = langid.label(pa.array([r[1] for r in rows], pa.string()), network)
    rows = [r for r, n, s in zip(rows, names, score, strict=True) if n != "und" and s >= 0.5]
    order = lambda r: (r[0] is None, r[0] or 0)
    best = {}
    for r in rows:
        key = r[1].translate(BLANKS)
        if key not in best or (-len(r[1]), order(r)) < (-len(best[key][1]), order(best[key])):
            best[key] = r
    rows = sorted(best.values(), key=order)
    roots = plain_components([plain_fingerprint(r[1]) for r in rows])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    out = []
    for r in rows:
        n, hit, _ = plain_hits(r[1], [(str(i), t) for i, t in bench], 13)
        if not hit or 20 * len(hit) < n:
            out.append(r)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("corpus")
    rows, bench = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_against_plain_versions(spark, folder):
    rows, bench = corpus()
    network = queries.language_network(spark.read.parquet(f"{folder}/documents.parquet"))
    want = plain_kept(rows, bench, network)
    assert 100 < len(want) <= len(rows) - 8
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r[0]: tokenizer.encode(r[1], add_special_tokens=False).ids + [2] for r in want}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == set(ids)
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        raw = b"".join(i.to_bytes(4, "little") for i in ids[p.doc_id][p.start : p.start + p.length])
        assert (p.ids_crc32, p.doc_tokens) == (zlib.crc32(raw), len(ids[p.doc_id]))


def test_stages_keep_the_columns_and_take_odd_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    nothing = docs.limit(0)
    twice = docs.where("doc_id in (1, 2) or doc_id is null").union(docs.where("doc_id in (1, 2)"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, folder).columns == docs.columns
        assert stage(spark, nothing, folder).collect() == []
        kept = stage(spark, twice, folder)
        assert kept.columns == docs.columns
        number = kept.count()
        assert number == (5 if name in ("language_id", "benchmark_decontamination") else 3), name
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, folder).collect() == []


def test_corpus_without_a_language(spark, tmp_path):
    """Only texts without a letter go in the first stage, although no language can be learned."""
    texts = ["one clean text here", "ein anderer sauberer Text", "日本", "A.", "123 456", "", None, "one  clean text here"]
    rows = [(k, t, None, "s", None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "another thing")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    name, first = corpus_pipeline.STAGES[0]
    assert sorted(r.doc_id for r in first(spark, docs, str(tmp_path)).collect()) == [0, 1, 2, 3, 7]
    assert sorted({p.doc_id for p in corpus_pipeline.run(spark, str(tmp_path)).collect()}) == [1, 2, 3, 7]
