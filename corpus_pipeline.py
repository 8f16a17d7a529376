"""A corpus pipeline: documents in, cleaned and encoded documents out, one Parquet table per stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``. All but the last return the columns of documents.

1. quality: documents with a quality score below 0.3 go. The model learns from the labelled ones among the input.
2. exact: of equal texts one document stays.
3. near: of each component of documents with shingle similarity of 0.8 or more, the one with the smallest id stays.
4. decontaminate: documents with words inside a benchmark window of 10 words go.
5. pieces: a sampled SentencePiece segmentation is added as ``ids``; ``text`` is what the ids decode to.

Nulls, empty texts, repeated rows and empty tables are handled as the operators state in their docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variascope.llm import decontaminate, exact, near, pieces, quality
from variascope.llm.io import table, written
from variascope.llm.text_queries import quality_model


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.where("score >= 0.3").select(*columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs, percent=80, pieces=12)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    decoded = pieces.decode(pieces.encode(docs))
    return decoded.select(*docs.columns, F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("decontaminate", decontaminate_stage),
    ("pieces", pieces_stage),
]

#: Training a model and sampling segmentations are not expressible in SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's table is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
