"""Rows for absent pairs, where a table of every key with every item is the result.

The present rows go in as they are. Items are numbered, every key lists the numbers that it lacks by stretches, and only those
become rows, so nothing is joined that is there already. Keys are cut into tiles of numbers, so a key is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variascope.plans.lineage import stored

TILE = 1 << 12


def lacking(rows: DataFrame, keys: DataFrame, items: DataFrame, *, key: str, item: str, tile: int = TILE) -> DataFrame:
    """(key, item): the pairs that ``rows`` lacks. Numbers of items are a written table, so Spark sees whether it is small."""
    spread = stored(items.select(item).distinct().withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    counts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))
    earlier = counts.select(F.col("_part").alias("_q"), "_m").collect()  # one row per partition
    starts, total = {}, 0
    for part, many in sorted((r["_q"], r["_m"]) for r in earlier):
        starts[part], total = total, total + many
    if not total:
        return keys.select(key, F.lit(None).cast(items.schema[item].dataType).alias(item)).where("false")
    offset = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("_part")]
    numbered = stored(spread.withColumn("_k", F.col("_id").bitwiseAND((1 << 33) - 1) + offset).select(item, "_k"))
    have = rows.select(key, item).join(numbered, item).groupBy(key, F.floor(F.col("_k") / tile).alias("_tile")).agg(F.collect_set("_k").alias("_have"))
    tiles = keys.select(key).distinct().withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((total - 1) // tile).cast("long"))))
    numbers = F.sequence(F.col("_tile") * tile, F.least((F.col("_tile") + 1) * tile, F.lit(total)) - 1)
    absent = tiles.join(have, [key, "_tile"], "left").select(key, F.explode(F.array_except(numbers, F.coalesce("_have", F.array().cast("array<bigint>")))).alias("_k"))
    return absent.join(numbered, "_k").select(key, item)


def filled(rows: DataFrame, keys: DataFrame, items: DataFrame, *, key: str, item: str, tile: int = TILE) -> DataFrame:
    """``rows`` (unique in key and item, both among the given ones) plus a row of nulls for each pair that they lack."""
    return rows.unionByName(lacking(rows, keys, items, key=key, item=item, tile=tile), allowMissingColumns=True)
