"""Query of the SentencePiece operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from variascope.llm import pieces
from variascope.llm.io import table


def op7_pieces(spark, sf_dir):
    """Sampled piece ids of every document, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source_text"))
    encoded = pieces.encode(docs, text="source_text")
    return pieces.decode(encoded).select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("text", 256).alias("text_sha256"),
        F.col("text").eqNullSafe(F.col("source_text")).alias("lossless"),
    )


QUERIES = {"op7_pieces": op7_pieces}
SQL = {}
