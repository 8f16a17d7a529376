"""Query of the personal data operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from variascope.llm import pii
from variascope.llm.io import table


def op10_pii(spark, sf_dir):
    """Counts and digests of the spans of personal data in every document."""
    found = pii.redactions(table(spark, sf_dir, "documents"))

    def spelled(kind, s):
        return F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))

    def base_of(kind):
        return F.transform(kind, lambda s: spelled(F.lit(kind), s))

    base = F.concat(*map(base_of, pii.KINDS))
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", lambda s: spelled(s["kind"], s)), ",").alias("spans"),
    )


QUERIES = {"op10_pii": op10_pii}
SQL = {}
