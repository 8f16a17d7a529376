"""Query of the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from variascope.llm import near
from variascope.llm.io import table

SQL_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[k:k + 4], ' ') AS g FROM (SELECT doc_id, words FROM w WHERE len(words) > 0) t,
  LATERAL (SELECT unnest(range(1, greatest(len(words) - 3, 2))) AS k) u),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS t FROM w UNION SELECT r.v, e.b FROM r JOIN e ON r.t = e.a),
m AS (SELECT v, min(t) AS component_id FROM r GROUP BY v)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM w JOIN m ON v = doc_id LEFT JOIN n USING (doc_id)
"""


def op4_near_dedup(spark, sf_dir):
    """Components of documents that are linked by a similarity of 0.85 of their shingle sets."""
    found = near.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


QUERIES = {"op4_near_dedup": op4_near_dedup}
SQL = {"op4_near_dedup": SQL_NEAR}
