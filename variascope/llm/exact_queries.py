"""Query of the exact deduplication."""

from __future__ import annotations

from variascope.llm import exact
from variascope.llm.io import table

SQL_EXACT = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


def op3_exact_dedup(spark, sf_dir):
    """Groups of equal texts and the row of each that stays."""
    return exact.groups(table(spark, sf_dir, "documents"))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
SQL = {"op3_exact_dedup": SQL_EXACT}
