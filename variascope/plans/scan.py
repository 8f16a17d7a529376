"""Running aggregates, islands and interval merging without one task per key.

A plain window over ``partitionBy(sample)`` pulls a whole sample into one task. These helpers cut the
ordered axis into tiles: a window inside (key, tile), one small window over tile totals, and a join of
the carried value. The input is repartitioned once by (key, tile); both branches reuse that exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variascope.plans.intervals import bin_of

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, inside: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(inside, carried)


def running(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: str,
    tile: Column,
    values: dict[str, tuple[str, str, bool]],
) -> DataFrame:
    """Add running aggregates along ``order`` inside ``keys``.

    ``values`` maps a new column to (kind, column, inclusive) with kind sum, max or min. ``tile`` must be
    non-decreasing in ``order``; rows must be unique in (keys, order).
    """
    keys = list(keys)
    tiled = df.withColumn("_tile", tile)
    tiled = tiled.repartition(*[F.col(k) for k in keys], F.col("_tile"))
    base = Window.partitionBy(*keys, "_tile").orderBy(order)
    inside = tiled
    for name, (kind, column, inclusive) in values.items():
        last = Window.currentRow if inclusive else -1
        inside = inside.withColumn(
            f"_in_{name}", _FOLD[kind](column).over(base.rowsBetween(Window.unboundedPreceding, last))
        )
    totals = tiled.groupBy(*keys, "_tile").agg(
        *[_FOLD[kind](column).alias(f"_tot_{name}") for name, (kind, column, _) in values.items()]
    )
    over_keys = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = over_keys.orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "_tile",
        *[_FOLD[kind](f"_tot_{name}").over(before).alias(f"_carry_{name}") for name, (kind, _, _) in values.items()],
    )
    joined = inside.join(carry, [*keys, "_tile"])
    for name, (kind, _, _) in values.items():
        joined = joined.withColumn(name, _combine(kind, F.col(f"_in_{name}"), F.col(f"_carry_{name}")))
    return joined.select(*df.columns, *values)


def value_tiles(df: DataFrame, column: str, n: int = 64) -> Column:
    """Tile number of a continuous column from approximate quantile cuts (any cuts give exact results)."""
    cuts = sorted(set(df.approxQuantile(column, [i / n for i in range(1, n)], 0.5 / n)))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(column)))


def islands(df: DataFrame, *, keys: Sequence[str], position: str, tile_width: int = 100_000) -> DataFrame:
    """Maximal runs of consecutive integer positions: (keys, start, end exclusive, n).

    Runs are built inside tiles; only runs that touch a tile edge are stitched (two per tile at most).
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, "_tile").orderBy(position)
    runs = (
        df.select(*keys, F.col(position).cast("long").alias("_p"))
        .withColumn("_tile", bin_of(F.col("_p"), tile_width))
        .withColumn("_g", F.col("_p") - F.row_number().over(inside.orderBy("_p")))
        .groupBy(*keys, "_tile", "_g")
        .agg(F.min("_p").alias("start"), (F.max("_p") + 1).alias("end"))
        .drop("_g")
    )
    at_edge = (F.col("start") == F.col("_tile") * tile_width) | (F.col("end") == (F.col("_tile") + 1) * tile_width)
    along = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("start")
    stitched = (
        runs.where(at_edge)
        .withColumn("_new", (F.coalesce(F.lag("end").over(along), F.lit(-1)) != F.col("start")).cast("int"))
        .withColumn("_g", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_g")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_g")
    )
    return (
        runs.where(~at_edge)
        .select(*keys, "start", "end")
        .unionByName(stitched)
        .withColumn("n", F.col("end") - F.col("start"))
    )


def place_intervals(
    df: DataFrame,
    *,
    keys: Sequence[str],
    start: str,
    end: str,
    overlap: int = 0,
    tile_width: int = 100_000,
) -> DataFrame:
    """One row per distinct (keys, start) with the start of the merged region it falls in.

    A start joins the open region when ``max(previous ends) - overlap > start``. Columns: keys, start,
    region_start, _e (largest end at that start), _n (rows at that start).
    """
    keys = list(keys)
    distinct_starts = df.groupBy(*keys, start).agg(F.max(end).alias("_e"), F.count(F.lit(1)).alias("_n"))
    tile = bin_of(F.col(start), tile_width)
    reach = running(
        distinct_starts, keys=keys, order=start, tile=tile, values={"_reach": ("max", "_e", False)}
    )
    opened = reach.withColumn(
        "_open", F.when(F.col("_reach").isNull() | (F.col("_reach") - overlap <= F.col(start)), F.col(start))
    )
    placed = running(
        opened, keys=keys, order=start, tile=tile, values={"region_start": ("max", "_open", True)}
    )
    return placed.select(*keys, start, "region_start", "_e", "_n")


def merge_intervals(
    df: DataFrame,
    *,
    keys: Sequence[str],
    start: str,
    end: str,
    overlap: int = 0,
    tile_width: int = 100_000,
) -> DataFrame:
    """Merged regions: keys, region_start, region_end, members."""
    placed = place_intervals(df, keys=keys, start=start, end=end, overlap=overlap, tile_width=tile_width)
    return placed.groupBy(*keys, "region_start").agg(
        F.max("_e").alias("region_end"), F.sum("_n").alias("members")
    )


def numbered(
    df: DataFrame, *, keys: Sequence[str], order: Sequence[Column], tile: Column, name: str = "rn"
) -> DataFrame:
    """1-based row number inside ``keys`` along ``order``, built from tiles plus the count of earlier tiles.

    ``tile`` must be non-decreasing in the first ordering column and constant for equal values of it.
    """
    keys = list(keys)
    tiled = df.withColumn("_tile", tile).repartition(*[F.col(k) for k in keys], F.col("_tile"))
    inside = tiled.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_tile").orderBy(*order)))
    over_keys = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = over_keys.orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        tiled.groupBy(*keys, "_tile")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, "_tile", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    )
    joined = inside.join(carry, [*keys, "_tile"])
    return joined.select(*df.columns, (F.col("_rn") + F.col("_before")).cast("long").alias(name))


def value_ranks(df: DataFrame, *, keys: Sequence[str], value: str, tile: Column | None = None) -> DataFrame:
    """Histogram with ranks: (keys, value, n, below) where ``below`` counts the smaller values of the key.

    Equal values are combined before the shuffle, so a value shared by very many rows is one row.
    """
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    tile = value_tiles(df, value) if tile is None else tile
    ranked = running(hist, keys=keys, order=value, tile=tile, values={"below": ("sum", "n", False)})
    return ranked.withColumn("below", F.coalesce("below", F.lit(0)).cast("long"))
