"""Cutting long lineages in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share (``spark.checkpoint.dir``).

    Only a local master, as in tests, gets a scratch folder when none is set; on a cluster this raises, since
    a folder of one machine would lose data between nodes.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path under the shared folder for a table or text that a later step reads back."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder named by ``spark.checkpoint.dir``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a new Parquet table in the shared folder, for loops that join a table with itself.

    A checkpoint keeps the size estimate of the plan behind it, and a join multiplies estimates, so after a dozen rounds the
    optimizer would spend its time on multiplying numbers of a million digits. A table that is read back has its own size.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
