"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from variascope.llm import tries
from variascope.llm.io import table

SQL_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[k:k + 2], ' ') AS g FROM (SELECT doc_id, words FROM w WHERE len(words) > 0) t,
  LATERAL (SELECT unnest(range(1, greatest(len(words) - 1, 2))) AS k) u),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)),
c AS (SELECT x.doc_id AS a, y.doc_id AS b FROM f x JOIN f y ON x.g = y.g AND x.doc_id < y.doc_id
  WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c),
r AS (SELECT doc_id AS v, doc_id AS t FROM w UNION SELECT r.v, e.b FROM r JOIN e ON r.t = e.a),
m AS (SELECT v, min(t) AS component_id FROM r GROUP BY v)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM w JOIN m ON v = doc_id LEFT JOIN n USING (doc_id)
"""


def op13_jaccard_join(spark, sf_dir):
    """Components of documents that are linked by a similarity of 0.9 of their sets of three words."""
    return tries.classes(table(spark, sf_dir, "documents"))


QUERIES = {"op13_jaccard_join": op13_jaccard_join}
SQL = {"op13_jaccard_join": SQL_JOIN}
