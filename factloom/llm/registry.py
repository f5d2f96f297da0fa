"""Queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers

from factloom.llm.common import table
from factloom.llm.decontamination import contamination_digest
from factloom.llm.embedding_dedup import near_duplicate_embeddings
from factloom.llm.hard_negatives import embedding_hard_negatives
from factloom.llm.language_id import identify_languages
from factloom.llm.packing import pack_documents
from factloom.llm.pii import pseudonymize, session_key
from factloom.llm.quality_rules import quality_digest
from factloom.llm.secrets import find_secrets
from factloom.llm.sharding import assign_shards
from factloom.llm.simhash import near_duplicates
from factloom.llm.source_divergence import source_divergence
from factloom.llm.toxicity import score_toxicity
from factloom.llm.warc import archive_round_trip


def op1_secrets(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return identify_languages(table(spark, sf_dir, "documents"))


def op3_sharding(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    found = archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark, sf_dir):
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_embedding_dedup(spark, sf_dir):
    return near_duplicate_embeddings(table(spark, sf_dir, "embeddings"))


def op9_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_pii(spark, sf_dir):
    return pseudonymize(table(spark, sf_dir, "documents"), session_key(spark))


def op11_quality_rules(spark, sf_dir):
    return quality_digest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return embedding_hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_secrets": op1_secrets,
        "op2_language_id": op2_language_id,
        "op3_sharding": op3_sharding,
        "op4_simhash": op4_simhash,
        "op5_warc": op5_warc,
        "op6_toxicity": op6_toxicity,
        "op7_decontamination": op7_decontamination,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_packing": op9_packing,
        "op10_pii": op10_pii,
        "op11_quality_rules": op11_quality_rules,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_source_divergence": op13_source_divergence,
    }


OP7_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), item_at AS (
    SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0
), item_windows AS (
    SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS span FROM item_at
), doc_at AS (
    SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT DISTINCT m FROM item_windows) WHERE len(w) >= m
), hits AS (
    SELECT doc_id, i, m, item_id FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS span FROM doc_at) JOIN item_windows USING (m, span)
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, m, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


OP5_SQL = """
WITH page AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), grouped AS (
    SELECT *, min(page_id) OVER (PARTITION BY h) AS lowest FROM page
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN lowest IS NULL OR page_id = lowest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lowest THEN lowest END AS refers_to
FROM grouped
"""

OP8_SQL = """
WITH RECURSIVE links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.93
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), found AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counted AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM found LEFT JOIN counted USING (vec_id)
"""

OP11_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), pieces AS (
    SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM words)
), duplicate_lines AS (
    SELECT r, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM pieces WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), windows AS (
    SELECT r, i, array_to_string(w[i:i + 7], ' ') AS span FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)
), again AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, span) AS n FROM windows) WHERE n > 1
), repeated AS (
    SELECT r, CAST(count(DISTINCT p) AS BIGINT) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r
), per_word AS (
    SELECT r, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words)
), by_word AS (
    SELECT r, CAST(sum(length(word)) AS BIGINT) AS word_chars, CAST(count(*) FILTER (WHERE regexp_matches(word, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')) AS BIGINT) AS n_letter_words,
           CAST(count(*) FILTER (WHERE word = before) AS BIGINT) AS n_echo_words
    FROM per_word GROUP BY r
), measured AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
           coalesce(n_letter_words, 0) AS n_letter_words, coalesce(n_echo_words, 0) AS n_echo_words
    FROM words LEFT JOIN duplicate_lines USING (r) LEFT JOIN repeated USING (r) LEFT JOIN by_word USING (r)
), judged AS (
    SELECT *, CAST(
        CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 15 * n_words THEN 4 ELSE 0 END
        + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 100 * n_letter_words < 60 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_echo_words > 25 * n_words THEN 128 ELSE 0 END AS BIGINT) AS failures
    FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       failures = 0 AS kept, failures, '3' AS policy
FROM judged
"""

OP12_SQL = """
WITH usable AS (
    SELECT row_number() OVER () AS r, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (
    SELECT * FROM usable WHERE vec_id % 100 = 0
), scored AS (
    SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id AS other, b.r AS o, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM anchors a JOIN usable b ON a.r <> b.r
), positives AS (
    SELECT anchor, anchor_id, o, other AS positive_id, score AS positive_score
    FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other NULLS LAST, o) AS n FROM scored WHERE same) WHERE n <= 5
), windows AS (
    SELECT p.anchor_id, p.positive_id, p.positive_score, s.other AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor, p.o ORDER BY s.score DESC, s.other NULLS LAST, s.o) AS n
    FROM positives p JOIN scored s ON s.anchor = p.anchor WHERE NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM windows WHERE n <= 5
"""

OP13_SQL = r"""
WITH given AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), used AS (
    SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM given) GROUP BY ALL
), kept AS (
    SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM used GROUP BY ALL HAVING count(*) >= 30
), by_source AS (
    SELECT lang, source, term, CAST(sum(u.n) AS BIGINT) AS n FROM used u JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
    SELECT lang, CAST(sum(n) AS BIGINT) AS n, count(*) AS v FROM kept GROUP BY ALL
), source_sizes AS (
    SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM by_source GROUP BY ALL
), groups AS (
    SELECT g.lang, g.source, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM given) g LEFT JOIN source_sizes s USING (lang, source)
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(b.n, 0) AS n, 1 + (1000000000 * (coalesce(b.n, 0) + 5)) // (g.n + 5 * z.v) AS p, 1 + (1000000000 * (k.n + 5)) // (z.n + 5 * z.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN sizes z USING (lang) LEFT JOIN by_source b ON b.lang = g.lang AND b.source = g.source AND b.term = k.term
), distances AS (
    SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), told AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM told
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql():
    return {
        "op11_quality_rules": OP11_SQL,
        "op12_hard_negatives": OP12_SQL,
        "op13_source_divergence": OP13_SQL,
        "op5_warc": OP5_SQL,
        "op7_decontamination": OP7_SQL,
        "op8_embedding_dedup": OP8_SQL,
    }
