"""Interval and as-of joins expressed as equi-joins on (keys, bin).

A range predicate alone makes Spark fall back to a nested loop. Here every interval is written once
per fixed-width bin it touches, every point sits in exactly one bin, and the exact predicate is a
residual of the hash/sort-merge join. Because a point has exactly one bin, the helper serves inner,
left, semi and anti joins without deduplication. ``salt`` spreads a bin that holds very many points
over several tasks (the interval side, which is the small annotation side, is repeated per salt).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width)).cast("long")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    *,
    point: str,
    start: str,
    end: str,
    on: Sequence[str] = (),
    width: int = 4096,
    how: str = "inner",
    salt: int = 1,
) -> DataFrame:
    """Join rows with ``start <= point < end``. ``on`` names equality keys present on both sides."""
    right = intervals.where(F.col(end) > F.col(start)).withColumn(
        "_bin", F.explode(F.sequence(bin_of(F.col(start), width), bin_of(F.col(end) - 1, width)))
    )
    left = points.withColumn("_bin", bin_of(F.col(point), width))
    keys = [*on, "_bin"]
    if salt > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salt)).cast("int"))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        keys.append("_salt")
    left, right = left.alias("_l"), right.alias("_r")
    cond = None
    for key in keys:
        equal = F.col(f"_l.{key}") == F.col(f"_r.{key}")
        cond = equal if cond is None else cond & equal
    cond = cond & (F.col(f"_l.{point}") >= F.col(f"_r.{start}")) & (F.col(f"_l.{point}") < F.col(f"_r.{end}"))
    joined = left.join(right, cond, how)
    columns = [F.col(f"_l.{c}") for c in points.columns]
    if how not in ("left_semi", "left_anti", "leftsemi", "leftanti"):
        columns += [F.col(f"_r.{c}") for c in intervals.columns if c not in on]
    return joined.select(*columns)


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    *,
    a_start: str,
    a_end: str,
    b_start: str,
    b_end: str,
    on: Sequence[str] = (),
    width: int = 4096,
) -> DataFrame:
    """Pairs of half-open intervals that overlap. Each pair is met only in the bin of its first shared base."""
    left = a.where(F.col(a_end) > F.col(a_start)).withColumn(
        "_bin", F.explode(F.sequence(bin_of(F.col(a_start), width), bin_of(F.col(a_end) - 1, width)))
    )
    right = b.where(F.col(b_end) > F.col(b_start)).withColumn(
        "_bin", F.explode(F.sequence(bin_of(F.col(b_start), width), bin_of(F.col(b_end) - 1, width)))
    )
    left, right = left.alias("_l"), right.alias("_r")
    first = F.greatest(F.col(f"_l.{a_start}"), F.col(f"_r.{b_start}"))
    cond = (F.col("_l._bin") == F.col("_r._bin")) & (F.col("_l._bin") == bin_of(first, width))
    for key in on:
        cond = cond & (F.col(f"_l.{key}") == F.col(f"_r.{key}"))
    cond = cond & (F.col(f"_l.{a_start}") < F.col(f"_r.{b_end}")) & (F.col(f"_r.{b_start}") < F.col(f"_l.{a_end}"))
    columns = [F.col(f"_l.{c}") for c in a.columns]
    columns += [F.col(f"_r.{c}") for c in b.columns if c not in on]
    return left.join(right, cond).select(*columns)


def last_at_or_before(
    points: DataFrame,
    anchors: DataFrame,
    *,
    point: str,
    anchor: str,
    on: Sequence[str] = (),
    width: int = 4096,
    how: str = "left",
) -> DataFrame:
    """As-of join: the last anchor row with ``anchor <= point`` (anchors unique per key).

    Anchors are annotation-sized, so one ``lead`` per key turns them into disjoint intervals for the binned join.
    The last, open-ended anchor of a key is one row and is attached by key.
    """
    keys = list(on)
    along = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(anchor)
    spans = anchors.withColumn("_until", F.lead(anchor).over(along))
    columns = [c for c in anchors.columns if c not in keys]
    closed = spans.where(F.col("_until").isNotNull()).select(
        *keys, "_until", F.col(anchor).alias("_from"), F.struct(*columns).alias("_hit")
    )
    rows = interval_join(points, closed, point=point, start="_from", end="_until", on=keys, width=width, how="left")
    tail = spans.where(F.col("_until").isNull()).select(*keys, F.struct(*columns).alias("_tail"))
    rows = rows.join(tail, keys, "left") if keys else rows.withColumn("_tail", tail.scalar())
    hit = F.coalesce("_hit", F.when(F.col(point) >= F.col("_tail")[anchor], F.col("_tail")))
    rows = rows.withColumn("_got", hit)
    if how == "inner":
        rows = rows.where(F.col("_got").isNotNull())
    return rows.select(*points.columns, *[F.col("_got")[c].alias(c) for c in columns])
