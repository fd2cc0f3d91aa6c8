"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tileflow.llm import byte_bpe, decontaminate, language_id, minhash, repeats, secrets, toxicity, unigram_counts, vector_links, warc
from tileflow.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(spark, table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.count_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages"))


def op5_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.link_vectors(spark, table(spark, sf_dir, "embeddings"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(spark, table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_documents(spark, table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_vector_links": op5_vector_links,
    "op6_minhash": op6_minhash,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_repeats": op10_repeats,
}

#: Links are pairs of rows; components are the smallest id over the closure of the links.
_CLOSURE = """, reach AS (
    SELECT u AS node, u AS seen FROM linked
    UNION
    SELECT r.node, l.v FROM reach r JOIN linked l ON l.u = r.seen
), component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
f AS (SELECT digest, max(page_id) AS first FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN f.first > d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first > d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON f.digest = d.digest AND d.n >= 1000""",
    "op5_vector_links": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
)""" + _CLOSURE + """
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT u, count(*) AS n FROM linked GROUP BY u) l ON l.u = e.vec_id
LEFT JOIN component c ON c.node = e.vec_id""",
    "op6_minhash": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), linked AS (
    SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
)""" + _CLOSURE + """
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN component c ON c.node = d.doc_id""",
    "op10_repeats": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, hash(array_to_string(words[i : i + 34], ' ')) AS h, md5(array_to_string(words[i : i + 34], ' ')) AS m
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT h, m FROM w GROUP BY h, m HAVING count(*) > 1) USING (h, m)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (
    SELECT doc_id, array_to_string(list(word ORDER BY i), ' ') AS kept, count(*) AS n
    FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
}
