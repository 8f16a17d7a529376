"""FASTA text as rows: records, contig index, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variascope.plans.scan import running


def parse_fasta(records: DataFrame, *, value: str = "value") -> DataFrame:
    """(contig, description, seq) from rows that each hold one record without its leading ``>``."""
    head = F.split(F.col(value), "\\r?\\n", 2)
    return records.where(F.length(F.trim(value)) > 0).select(
        *[c for c in records.columns if c != value],
        F.get(F.split(head[0], "\\s+"), F.lit(0)).alias("contig"),
        F.trim(head[0]).alias("description"),
        F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), "\\s", "").alias("seq"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. The reader splits at a ``>`` that begins a line; records keep their file order through block
    and row ids. The first record of a file keeps its own ``>``, which is cut off."""
    rows = spark.read.text(path, lineSep="\n>").select(
        F.regexp_replace("value", "^>", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("record")
    )
    return parse_fasta(rows)


def contig_index(contigs: DataFrame, *, tile: int = 1000) -> DataFrame:
    """Cumulative start of every contig in ``contig_idx`` order (exclusive prefix sum of ``len``)."""
    rows = running(
        contigs, keys=[], order="contig_idx", tile=F.floor(F.col("contig_idx") / tile), values={"_s": ("sum", "len", True)}
    )
    return rows.withColumn("start", F.col("_s") - F.col("len")).drop("_s")
