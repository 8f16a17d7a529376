"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 fingerprints every whole text and writes (id, fingerprint, code points), then builds a Bloom filter of the
fingerprints that may repeat (``bloom``). Pass 2 tests every row against the broadcast filter, in place: rows that
are not in it are unique and pass straight through; only the others are shuffled and grouped by full fingerprint.
In ``deduplicate`` the texts of those others shuffle by (id, fingerprint), never by group, so a group with a third
of all rows is spread over all tasks; in ``groups`` the rows meet their group's one-row summary in a join whose
skewed side adaptive execution splits.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Of equal texts the row with
the most code points in the original text stays, then the smallest id (null ids last).

Defined cases: a null text counts as empty; empty, blank and null texts are equal; of rows repeated with id and text
exactly one stays; an empty table gives an empty result; columns named like internal ones are not touched, since
only the id and the text are read (``groups``) or internal names carry an underscore prefix (``deduplicate``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variascope.llm import bloom
from variascope.llm.io import written

_BLANK = "[\\x20\\x09-\\x0D]+"


def fingerprint(text: str) -> Column:
    """Lower-case hex SHA-256 of the text without blanks, in UTF-8."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _BLANK, ""), 256)


def points(text: str) -> Column:
    return F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long")


def _prints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Written table (_row, _key, _print, _points) of all rows."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(key).alias("_key"),
        F.unhex(fingerprint(text)).alias("_print"),
        points(text).alias("_points"),
    )
    return written(rows, "prints")


def _best() -> Column:
    """The row of a group that stays."""
    return F.min(F.struct((-F.col("_points")).alias("p"), F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_row").alias("r")))


def _flagged(prints: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    bits = bloom.bits_for(prints.count())
    words = bloom.repeated(prints, "_print", bits)
    return bloom.flag(prints, "_print", words, bits, "_maybe"), words, bits


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    flagged = _flagged(_prints(docs, key, text))[0]
    once = flagged.where(~F.col("_maybe")).select(
        F.col("_key").alias(key),
        F.col("_key").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.lower(F.hex("_print")).alias("text_sha256"),
    )
    maybe = flagged.where("_maybe").select("_row", "_key", "_print", "_points")
    # a written table, so that both sides of the join are plain exchanges and a skewed one can be split
    best = written(maybe.groupBy("_print").agg(_best().alias("_best"), F.count(F.lit(1)).alias("group_size")), "best")
    more = maybe.join(best, "_print").select(
        F.col("_key").alias(key),
        F.col("_best.k").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best.r")).alias("kept"),
        F.lower(F.hex("_print")).alias("text_sha256"),
    )
    return once.unionByName(more)


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with their own columns."""
    flagged, words, bits = _flagged(_prints(docs, key, text))
    keepers = (
        flagged.where("_maybe")
        .groupBy("_print")
        .agg(_best().alias("_best"))
        .select("_print", F.coalesce(F.col("_best.k").cast("string"), F.lit("")).alias("_id"), (-F.col("_best.p")).alias("_points"))
    )
    columns = [f"`{c}`" for c in docs.columns]
    ready = bloom.flag(docs.withColumn("_print", F.unhex(fingerprint(text))), "_print", words, bits, "_maybe")
    once = ready.where(~F.col("_maybe")).select(*columns)
    more = (
        ready.where("_maybe")
        .withColumns({"_id": F.coalesce(F.col(key).cast("string"), F.lit("")), "_points": points(text)})
        .join(keepers, ["_print", "_id", "_points"], "left_semi")
        .dropDuplicates(["_print", "_id", "_points"])
        .select(*columns)
    )
    return once.unionByName(more)
