"""Line-oriented text with exact line numbers, read in parallel.

Order inside a split comes from the row id of the scan, which counts on without gaps; splits of a file are put in sequence by their
start offset. So a line number is the row id plus a number of its split, from one small row per file split that every task
gets. Lines are neither sorted nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 0, value)."""
    rows = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"),
    )
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        rows.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_c"), F.min("_id").alias("_first"))
        .select("file", "_at", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    return rows.join(F.broadcast(splits), ["file", "_at"]).select("file", (F.col("_id") + F.col("_shift")).alias("line_no"), "value")


def base_name(path):
    return F.element_at(F.split(path, "/"), -1)
