"""Query of the WARC operator."""

from __future__ import annotations

from variascope.llm import warc
from variascope.llm.io import table

SQL_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN best END AS refers_to
FROM d
"""


def op1_warc(spark, sf_dir):
    """Every page written to WARC archives and read back through their index."""
    index, folder = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc": op1_warc}
SQL = {"op1_warc": SQL_WARC}
