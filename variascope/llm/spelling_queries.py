"""Query of the spelling variants."""

from __future__ import annotations

from variascope.llm import spelling
from variascope.llm.io import table

SQL_SPELLING = r"""
WITH RECURSIVE t AS (SELECT list(list_reduce([i] || range(8), lambda c, b: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''),
  lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195, unicode(ch)::BIGINT - 64] END)) AS bytes FROM d),
h AS (SELECT run, n, xor(4294967295, list_reduce([4294967295] || bytes, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS h FROM b, t),
p AS (SELECT n, CASE WHEN h % 199 = 0 THEN run[1:(h % length(run))] || run[(h % length(run) + 2):] ELSE run END AS word FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM p WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
k AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS less FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
e AS (SELECT DISTINCT word, near, m FROM (
  SELECT k.word, v.word AS near, v.n AS m FROM k JOIN v ON k.less = v.word
  UNION ALL SELECT v.word, k.word, k.n FROM k JOIN v ON k.less = v.word
  UNION ALL SELECT x.word, y.word, y.n FROM k x JOIN k y ON x.less = y.less AND x.i = y.i AND x.word <> y.word)),
f AS (SELECT word, count(*) AS n_near, min((-m, near)) AS best FROM e GROUP BY word),
g AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form,
  CASE WHEN -best[1] >= 5 * n THEN -best[1] END AS form_n FROM v LEFT JOIN f USING (word)),
w AS (SELECT word, word AS at FROM g UNION ALL SELECT w.word, g.form FROM w JOIN g ON w.at = g.word WHERE g.form IS NOT NULL)
SELECT g.word, g.n, g.n_near, g.form, g.form_n, w.at AS root FROM g JOIN w ON w.word = g.word JOIN g z ON z.word = w.at WHERE z.form IS NULL
"""


def op12_spelling(spark, sf_dir):
    """Words, their near words and the forms that they lead to."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), noise=199)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op12_spelling": op12_spelling}
SQL = {"op12_spelling": SQL_SPELLING}
