"""Queries of this subpackage and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import fingerprints, language_id, license_scan, mixing, ngram_join, packing, quality_cnn, substring_dedup, topk_search, warc
from .runtime import default_tokenizer, table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    out = topk_search.top_k(vectors.where(F.col("id") % 20 == 0), vectors, k=20)
    return out.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64e0 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS token
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) AS i FROM d)),
n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both FROM s a JOIN s b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c.both >= 85 * (x.n + y.n - c.both)),
r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.doc_id, links.v FROM r JOIN links ON links.u = r.reached)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("hits", lambda h: h["confirmed"])
    best = F.element_at(F.array_sort(sure, lambda a, b: F.when(a["probability"] > b["probability"], -1).when(a["probability"] < b["probability"], 1).otherwise(0)), 1)
    made = made.withColumn("best", F.when(F.size(sure) > 0, best))
    return made.select(
        "doc_id", "n_paragraphs", F.size("hits").alias("n_hits"), F.size(sure).alias("n_confirmed"), F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda h: h["family"]))), ",").alias("families"),
        F.col("best.family").alias("best_family"), F.col("best.probability").alias("best_probability"), F.col("best.similarity").alias("best_similarity"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return made.select("doc_id", "tokens", *[F.element_at("posterior", i + 1).alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)], "rate")


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    made = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path or default_tokenizer())
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex,
         min(page_id) OVER (PARTITION BY sha1(payload)) AS first_id FROM p),
d AS (
  SELECT *, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) // CAST(pow(32, 3 - k) AS BIGINT)) % 32 + 1 AS INT), 1)), '')), '') AS payload_digest FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = quality_cnn.quality_scores(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return made.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = substring_dedup.remove_repeats(docs, window=35)
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join("kept_words", " ").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (
  SELECT doc_id, i FROM s SEMI JOIN (SELECT words FROM s GROUP BY words HAVING count(*) > 1) USING (words)),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM again) GROUP BY doc_id),
kept AS (
  SELECT x.doc_id, len(w) AS n, CASE WHEN ps IS NULL THEN 0 ELSE len(ps) END AS removed, w, ps
  FROM d x LEFT JOIN gone USING (doc_id)),
k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) x
  ANTI JOIN (SELECT doc_id, unnest(ps) AS i FROM gone) g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(removed AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM kept LEFT JOIN k USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_exact_topk": op1_exact_topk, "op2_fingerprints": op2_fingerprints, "op3_ngram_join": op3_ngram_join, "op4_language_id": op4_language_id, "op5_license_scan": op5_license_scan, "op6_mixing": op6_mixing, "op7_packing": op7_packing, "op8_warc": op8_warc, "op9_quality": op9_quality, "op10_substring_dedup": op10_substring_dedup, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op3_ngram_join": OP3_SQL, "op8_warc": OP8_SQL, "op10_substring_dedup": OP10_SQL}
