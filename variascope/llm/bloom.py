"""A Bloom filter of repeated keys as a small table, in DataFrame functions only.

A key sets two positions of ``bits``. Rows per position are counted with map-side combining; the filter holds the
positions that two or more rows have hit, packed into 64-bit words, so it is sparse when few keys repeat. It has at
most bits / 64 rows whatever the data, which bounds what is broadcast; with more keys than it was made for, more
rows pass as possible repeats and results stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 12, 1 << 27


def bits_for(rows: int) -> int:
    """A power of two, 16 to 32 bits a row, at most ``MOST_BITS`` (filter words then take 32 MB)."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(rows, 1) - 1).bit_length()))


def positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(bits)) for salt in (1, 2)]


def _packed(places: DataFrame) -> DataFrame:
    """(word, mask) from one row per position ``p``."""
    return places.groupBy(F.expr("shiftright(p, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask")
    )


def repeated(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """(word, mask): positions hit by two or more rows."""
    hit = rows.select(F.explode(F.array(*positions(F.col(key), bits))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return _packed(hit.where("n > 1"))


def present(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """(word, mask): positions of the keys in ``rows``."""
    return _packed(rows.select(F.explode(F.array(*positions(F.col(key), bits))).alias("p")))


def flag(rows: DataFrame, key: str, words: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` plus a boolean ``name``: both positions of ``key`` are in the filter ``words``. No shuffle of ``rows``."""
    out, found = rows, F.lit(True)
    for k, place in enumerate(positions(F.col(key), bits)):
        mask, at = f"_mask{k}", f"_word{k}"
        out = out.withColumn(at, F.shiftright(place, 6)).join(
            F.broadcast(words.select(F.col("word").alias(at), F.col("mask").alias(mask))), at, "left"
        )
        bit = F.call_function("shiftright", F.coalesce(F.col(mask), F.lit(0).cast("long")), (place.bitwiseAND(F.lit(63))).cast("int"))
        found = found & (bit.bitwiseAND(F.lit(1).cast("long")) == 1)
    return out.withColumn(name, found).drop("_mask0", "_mask1", "_word0", "_word1")
