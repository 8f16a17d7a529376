"""Tables of a data folder, as the registered queries read them, and tables written on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from variascope.plans.lineage import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a new Parquet table in the shared folder: lineage ends there and lost executors cost no rerun."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
