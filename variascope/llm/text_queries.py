"""Queries of the operators that map over whole texts: decontamination, quality, licences."""

from __future__ import annotations

from pyspark.sql import functions as F

from variascope.llm import decontaminate, licenses, quality
from variascope.llm.io import table

SQL_DECONTAMINATE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS words
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower_ascii, '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS words
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
p AS (SELECT DISTINCT item_id, m, words[k:k + m - 1] AS win FROM (SELECT item_id, words, least(10, len(words)) AS m FROM b WHERE len(words) > 0) t,
  LATERAL (SELECT unnest(range(1, len(words) - m + 2)) AS k) u),
sizes AS (SELECT DISTINCT m FROM p),
d AS (SELECT doc_id, k, m, words[k:k + m - 1] AS win FROM (SELECT doc_id, words, m FROM w, sizes WHERE len(words) >= m) t,
  LATERAL (SELECT unnest(range(1, len(words) - m + 2)) AS k) u),
hits AS (SELECT doc_id, k, d.m, item_id FROM d JOIN p ON d.m = p.m AND d.win = p.win),
covered AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hits, LATERAL (SELECT unnest(range(0, m)) AS j) u GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op5_decontaminate(spark, sf_dir):
    """Words of each document inside a benchmark window of 10 words."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remainder(key: str):
    """crc32 of the id as text, modulo 5; the rows with 0 are held out from learning."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5))


def quality_model(spark, docs, sf_dir):
    return quality.fit(docs, table(spark, sf_dir, "labels"), learn=remainder("doc_id") != 0)


def op8_quality(spark, sf_dir):
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir), keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op9_licenses(spark, sf_dir):
    """Licence phrases and notices in every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


QUERIES = {"op5_decontaminate": op5_decontaminate, "op8_quality": op8_quality, "op9_licenses": op9_licenses}
SQL = {"op5_decontaminate": SQL_DECONTAMINATE}
