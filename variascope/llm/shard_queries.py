"""Query of the sharding operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from variascope.llm import shards
from variascope.llm.io import table


def op2_shards(spark, sf_dir):
    """All documents in 24 shards of near-equal bytes."""
    placed = shards.assign(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op2_shards": op2_shards}
SQL = {}
