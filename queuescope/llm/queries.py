"""Queries of the operators, over whole tables, and their SQL twins."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuescope.llm import decontam, exact, fracsketch, langid, lm, merkle, negatives, packing, simhash, substring, tokencount, toxicity, warc
from queuescope.llm.common import Scratch, crc_mod


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    lexicon = toxicity.train(docs, labels.where(crc_mod("doc_id", 3) != 1))
    return toxicity.score(docs, lexicon).select(
        "doc_id",
        (crc_mod("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def language_network(docs: DataFrame) -> langid.Network | None:
    """Fitted on the documents that are not held out."""
    return langid.train(docs.where(crc_mod("doc_id", 4) != 2))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    labels = langid.identify(docs, language_network(docs))
    return labels.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    pieces = tokencount.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.count_tokens(_table(spark, folder, "documents"), pieces)


def op4_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score is the mean of the words' logarithms."""
    scores = lm.backoff_scores(_table(spark, folder, "documents"))
    mean = F.col("log_score") / F.greatest("n_words", F.lit(1))
    return scores.select("doc_id", "n_words", "n_backoff", "n_unseen", F.round(mean, 6).alias("score"))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return substring.remove_repeats(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(_table(spark, folder, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    config = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    return packing.pack(docs, config).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(_table(spark, folder, "documents"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    archive = warc.write_archive(_table(spark, folder, "pages"), scratch)
    return warc.read_pages(archive, scratch)


def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_components(_table(spark, folder, "documents"))


def op11_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fracsketch.fingerprints(_table(spark, folder, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fracsketch.fingerprint(F.col("sketch")).alias("fingerprint"),
        fracsketch.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return document_manifest(_table(spark, folder, "documents"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """Proof of each document, and whether the row as it is found (some are tampered with) still gives the root."""
    found = merkle.manifest(merkle.document_leaves(docs), Scratch(docs.sparkSession, "merkle"))
    found = merkle.fold(found.withColumn("claim", F.coalesce("tampered", "leaf")), "claim", "folded")
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("id").alias("doc_id"),
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        F.sha2(text("path"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return mined_negatives(_table(spark, folder, "embeddings"))


def mined_negatives(rows: DataFrame) -> DataFrame:
    """Every seventh vector has its label moved on by one first; every hundredth is an anchor."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


ORACLES = {
    "op4_lm_scores": r"""
        WITH w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
        pairs AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM each),
        by_doc AS (SELECT doc_id, word, count(*) AS n FROM each GROUP BY ALL),
        by_word AS (SELECT word, sum(n) AS n FROM by_doc GROUP BY ALL),
        pair_doc AS (SELECT doc_id, prev, word, count(*) AS n FROM pairs WHERE prev IS NOT NULL GROUP BY ALL),
        pair_all AS (SELECT prev, word, sum(n) AS n FROM pair_doc GROUP BY ALL),
        word_left AS (SELECT doc_id, word, by_word.n - by_doc.n AS c FROM by_doc JOIN by_word USING (word)),
        pair_left AS (SELECT doc_id, prev, word, pair_all.n - pair_doc.n AS c
                      FROM pair_doc JOIN pair_all USING (prev, word)),
        total AS (SELECT sum(len(words)) AS n FROM w),
        scored AS (
            SELECT p.doc_id, u.c AS c, p.prev IS NOT NULL AND b.c = 0 AS backoff,
                   CASE WHEN b.c > 0 THEN ln(b.c / v.c)
                        ELSE ln(greatest(u.c, 0.5) / greatest(total.n - len(w.words), 1))
                             + CASE WHEN p.prev IS NULL THEN 0 ELSE ln(0.4) END END AS value
            FROM pairs p JOIN w USING (doc_id) CROSS JOIN total
            JOIN word_left u ON u.doc_id = p.doc_id AND u.word = p.word
            LEFT JOIN pair_left b ON b.doc_id = p.doc_id AND b.prev = p.prev AND b.word = p.word
            LEFT JOIN word_left v ON v.doc_id = p.doc_id AND v.word = p.prev),
        sums AS (SELECT doc_id, count(*) FILTER (WHERE backoff) AS n_backoff, count(*) FILTER (WHERE c = 0) AS n_unseen,
                        round(sum(value) / count(*), 6) AS score
                 FROM scored GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_backoff, 0) AS n_backoff,
               coalesce(n_unseen, 0) AS n_unseen, coalesce(score, 0.0) AS score
        FROM w LEFT JOIN sums USING (doc_id)
    """,
    "op5_benchmark_decontamination": r"""
        WITH w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents),
        items AS (
            SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM benchmark),
        phrases AS (
            SELECT DISTINCT item_id, least(len(words), 13) AS size,
                   array_to_string(list_slice(words, i, i + least(len(words), 13) - 1), ' ') AS phrase
            FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i
                  FROM items WHERE len(words) > 0)),
        sizes AS (SELECT DISTINCT size FROM phrases),
        starts AS (
            SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
            FROM w, sizes WHERE len(words) >= size),
        hits AS (
            SELECT s.doc_id, s.i, s.size, p.item_id
            FROM (SELECT doc_id, i, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS phrase
                  FROM starts) s JOIN phrases p USING (size, phrase)),
        hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit
                FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op6_substring_dedup": r"""
        WITH w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        windows AS (
            SELECT doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS seq
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
        later AS (
            SELECT doc_id, i FROM windows
            QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
        each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text
                 FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
        removed AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """,
    "op9_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
        -- Five hexadecimal digits are four digits of base 32.
        d AS (SELECT page_id, payload, array_to_string(list_transform(range(32), lambda i: substr(
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '')
                  AS payload_digest
              FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM d)
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM m
    """,
    "op11_document_fingerprints": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
        o AS (SELECT doc_id, text, n, row_number() OVER w AS k,
                     coalesce(lead(text) OVER w, first_value(text) OVER w) AS after
              FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text)),
        e AS (SELECT *, substr(text, 1, n - n // 2) || substr(after, 1, n // 2) AS edited FROM o),
        texts AS (SELECT DISTINCT unnest([text, edited, after]) AS t FROM e),
        words AS (SELECT t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
        hashes AS MATERIALIZED (
            SELECT t, list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1),
                                     lambda i: md5(array_to_string(list_slice(w, i, i + 4), ' '))) AS h FROM words),
        low AS (SELECT t, h, list_filter(h, lambda x: x < '20000000') AS x FROM hashes),
        s AS MATERIALIZED (
            SELECT t, list_sort(list_distinct(list_transform(
                       CASE WHEN len(x) > 0 THEN x WHEN len(h) > 0 THEN [list_min(h)] ELSE [] END,
                       lambda y: substr(y, 1, 16)))) AS s
            FROM low)
        SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256,
               array_to_string(a.s, '') AS fingerprint, array_to_string(b.s, '') AS edited_fingerprint,
               CASE WHEN least(len(a.s), len(b.s)) > 0
                    THEN len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s))
                    ELSE CAST(len(a.s) = len(b.s) AS DOUBLE) END AS near_edited,
               CASE WHEN least(len(a.s), len(c.s)) > 0
                    THEN len(list_intersect(a.s, c.s)) / least(len(a.s), len(c.s))
                    ELSE CAST(len(a.s) = len(c.s) AS DOUBLE) END AS near_next
        FROM e JOIN s a ON a.t = text JOIN s b ON b.t = edited JOIN s c ON c.t = after
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, lang, n_chars, row_number() OVER () AS r,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                       || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                   coalesce(strlen(text) || ':' || text, '-') AS tail,
                   -- CRC-32 of the decimal doc_id, byte by byte and bit by bit.
                   xor(4294967295, list_reduce(
                       list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                       lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                                lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) AS crc
            FROM documents),
        hashed AS (
            SELECT *, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                   CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL
                        THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS bad
            FROM texts),
        leaves AS MATERIALIZED (
            SELECT *, coalesce('1' || lang, '0') AS tree, count(*) OVER (PARTITION BY lang) AS n,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k
            FROM hashed),
        up AS (
            SELECT tree, 0 AS level, k, n, leaf AS node FROM leaves
            UNION ALL
            SELECT tree, level + 1, k // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY k))
            FROM up WHERE n > 1 GROUP BY tree, level, k // 2),
        subroots AS MATERIALIZED (
            SELECT tree, level AS height, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS n
            FROM up WHERE n = 1),
        top AS (
            SELECT 0 AS level, k, n, subroot AS node FROM subroots
            UNION ALL
            SELECT level + 1, k // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY k))
            FROM top WHERE n > 1 GROUP BY level, k // 2),
        below AS (
            SELECT r, g.level AS step, (l.k >> g.level) % 2 = 1 AS is_right, u.node AS other
            FROM leaves l JOIN subroots USING (tree), unnest(range(height)) AS g(level)
            LEFT JOIN up u ON u.tree = l.tree AND u.level = g.level AND u.k = xor(l.k >> g.level, 1)),
        above AS (
            SELECT r, height + g.level AS step, (s.k >> g.level) % 2 = 1 AS is_right, t.node AS other
            FROM leaves l JOIN subroots s USING (tree), unnest(range((SELECT max(level) FROM top))) AS g(level)
            LEFT JOIN top t ON t.level = g.level AND t.k = xor(s.k >> g.level, 1)),
        path AS MATERIALIZED (SELECT * FROM below UNION ALL SELECT * FROM above),
        folded AS (
            SELECT r, 0 AS step, coalesce(bad, leaf) AS node FROM leaves
            UNION ALL
            SELECT f.r, f.step + 1, CASE WHEN is_right THEN sha256(other || f.node) ELSE sha256(f.node || coalesce(other, '')) END
            FROM folded f JOIN path p ON p.r = f.r AND p.step = f.step),
        proof AS (SELECT r, coalesce(string_agg(other, '' ORDER BY step), '') AS text FROM path GROUP BY r),
        root AS (SELECT node AS root FROM top WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof.text, '')) AS proof_sha256, f.node AS folded_root,
               f.node = root AS verified
        FROM leaves l JOIN subroots s USING (tree) CROSS JOIN root LEFT JOIN proof USING (r)
        JOIN (SELECT r, arg_max(node, step) AS node FROM folded GROUP BY r) f USING (r)
    """,
    "op13_hard_negatives": r"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same,
                   CAST(list_inner_product(CAST(a.x AS DOUBLE[]), CAST(o.x AS DOUBLE[])) AS BIGINT) AS score
            FROM v a, v o WHERE a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
               s.other AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
        QUALIFY rank <= 5
    """,
}

QUERIES = [
    op1_toxicity,
    op2_language_id,
    op3_token_counts,
    op4_lm_scores,
    op5_benchmark_decontamination,
    op6_substring_dedup,
    op7_packing,
    op8_exact_dedup,
    op9_warc,
    op10_simhash_near_dedup,
    op11_document_fingerprints,
    op12_merkle_manifest,
    op13_hard_negatives,
]
