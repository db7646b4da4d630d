"""The training-data operators as registered queries: each applies one operator, with production
parameters, to its whole table and returns every row."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, importance, langid, mixing, near_dups, pieces, prefix_trie, quality_rules, suffixes, token_counts, warc
from .common import load, spread


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's file; LODESTONE_TOKENIZERS names another folder than the installed one."""
    if folder := os.environ.get("LODESTONE_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(load(spark, sf_dir, "pages"))


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.label_languages(documents(spark, sf_dir))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_digest(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target text: documents labelled good; as many are drawn as that label's share among all labels says."""
    labels = load(spark, sf_dir, "labels").where(F.col("quality").isNotNull())
    share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0] or 0.0
    return importance.resample(documents(spark, sf_dir), labels.where(F.col("quality") == 1).select("doc_id"), share)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_table(bpe.encoded_lengths(documents(spark, sf_dir), vocabulary()))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).drop("source")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(load(spark, sf_dir, "conversations"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), vocabulary(), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_near_dups": op3_near_dups,
    "op4_language_id": op4_language_id,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
        FROM m""",
    "op3_near_dups": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
             e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
             l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
             r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
             c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
        SELECT doc_id, len(sh) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept FROM s LEFT JOIN c ON x = doc_id""",
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             p AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d),
             w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 200 <= len(h) THEN md5(substr(h, 2 * i + 1, 200)) END AS k FROM p),
             f AS (SELECT doc_id, i, b, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM w),
             g AS (SELECT doc_id, i, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
             o AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g)
        SELECT d.doc_id, len(any_value(h)) // 2 AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
               sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
        FROM d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op12_prefix_trie": r"""
        WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM conversations WHERE conv_id IS NOT NULL),
             i AS (SELECT conv_id, count(*) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                     lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h FROM o GROUP BY conv_id),
             b AS (SELECT i.conv_id, i.h, least(i.h, coalesce(k.n, 0)) AS given FROM i LEFT JOIN i k ON k.conv_id = i.conv_id - i.conv_id % 100),
             t AS (SELECT b.conv_id, o.rn AS d, role, text FROM b JOIN o ON o.conv_id = b.conv_id - b.conv_id % 100 WHERE o.rn <= b.h
                   UNION ALL SELECT b.conv_id, given + o.rn - b.h, role, text FROM b JOIN o ON o.conv_id = b.conv_id WHERE o.rn > b.h),
             x AS (SELECT conv_id, d, length(text) AS letters, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS path FROM t
                   UNION ALL SELECT conv_id, 0, 0, '' FROM i),
             y AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS last FROM x),
             g AS (SELECT d, path, any_value(up) AS up, min(conv_id) AS low, count(*) AS n_convs, (count(*) - 1) * any_value(letters) AS own,
                          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM y GROUP BY d, path),
             k AS (SELECT g.*, (SELECT count(*) FROM g c WHERE c.d = g.d + 1 AND c.up = g.path) AS n_children FROM g),
             s AS (SELECT a.d, a.path, sum(k.own) AS saved, count(*) FILTER (k.n_children = 0) AS leaves FROM k JOIN y a ON a.conv_id = k.low AND a.d <= k.d GROUP BY a.d, a.path)
        SELECT k.low AS conv_id, k.d AS depth, p.low AS parent_conv_id, k.n_convs, k.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, k.ends_sha256
        FROM k JOIN s ON s.d = k.d AND s.path = k.path LEFT JOIN k p ON p.d = k.d - 1 AND p.path = k.up""",
}
