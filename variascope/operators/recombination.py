"""Recombination signals and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variascope.plans.intervals import bin_of, interval_join
from variascope.plans.scan import merge_intervals, running


def nearby_products(cells: DataFrame, *, reach: int, key) -> DataFrame:
    """Sum of x*y for every ordered pair of rows ``a < b`` closer than ``reach`` that share a sample.

    Only non-zero cells enter (x*y needs both). Cells are matched on (sample, tile), each left tile also with its
    right neighbour, so the number of partners of a cell is bounded by the positions within reach.
    """
    left = cells.select(
        "sample", F.struct(*key).alias("a"), F.col("p").alias("pa"), F.col("x").alias("xa"),
        F.explode(F.array(bin_of(F.col("p"), reach), bin_of(F.col("p"), reach) + 1)).alias("t"),
    )
    right = cells.select(
        "sample", F.struct(*key).alias("b"), F.col("p").alias("pb"), F.col("x").alias("xb"),
        bin_of(F.col("p"), reach).alias("t"),
    )
    return (
        left.join(right, ["sample", "t"])
        .where((F.col("a") < F.col("b")) & (F.col("pb") - F.col("pa") < reach))
        .groupBy("a", "b")
        .agg(F.sum(F.col("xa") * F.col("xb")).alias("sxy"))
    )


def _with_moments(pairs: DataFrame, cells: DataFrame, key) -> DataFrame:
    one = cells.groupBy(F.struct(*key).alias("k")).agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    return pairs.join(one.select(F.col("k").alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa")), "a").join(
        one.select(F.col("k").alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb")), "b"
    )


def local_correlation(
    cells: DataFrame, *, n_samples: int, distance: int = 500, threshold: float = 0.75, key=("p",), sites: DataFrame | None = None
) -> DataFrame:
    """Pairs of sites whose mutant frequencies correlate over all samples, both within ``distance`` of a focal site.

    cells: p, (allele), sample, x with x > 0; absent cells are 0 and enter through ``n_samples``. A focal site must
    lie beyond the first ``distance`` positions; a pair may therefore be up to twice the distance apart. Sites
    without variance have no correlation and are never reported.
    """
    cells = cells.where("x <> 0")
    sites = cells.select("p").distinct() if sites is None else sites
    pairs = _with_moments(nearby_products(cells, reach=2 * distance, key=key), cells, key)
    n = F.lit(float(n_samples))
    cov = n * F.col("sxy") - F.col("sa") * F.col("sb")
    va = n * F.col("qa") - F.col("sa") * F.col("sa")
    vb = n * F.col("qb") - F.col("sb") * F.col("sb")
    strong = pairs.where((va > 1e-12) & (vb > 1e-12)).withColumn("r", cov / F.sqrt(va * vb)).where(F.col("r") > threshold)
    windows = strong.select(
        "a", "b", "r",
        F.greatest(F.col("b.p") - distance + 1, F.lit(distance + 1)).alias("lo"),
        (F.col("a.p") + distance).alias("hi"),
    )
    focal = interval_join(
        sites.select(F.col("p").alias("f")), windows, point="f", start="lo", end="hi", width=max(64, distance)
    )
    return focal.groupBy("a", "b").agg(F.max("r").alias("r"))


def flagged_keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a.*")).unionByName(pairs.select(F.col("b.*"))).distinct()


def per_allele_correlation(
    cells: DataFrame, *, n_samples: int, distance: int = 500, threshold: float = 0.75
) -> tuple[DataFrame, DataFrame]:
    """Allele-wise form: cells (p, allele, sample, x). Returns (cells with ``recombinant``, sites with their status).

    A site is dropped only when all its mutant cells are recombinant, else it is partial if any of them is.
    """
    live = cells.where("x <> 0")
    flagged = flagged_keys(
        local_correlation(live, n_samples=n_samples, distance=distance, threshold=threshold, key=("p", "allele"))
    ).withColumn("recombinant", F.lit(True))
    marked = live.join(flagged, ["p", "allele"], "left").withColumn("recombinant", F.coalesce("recombinant", F.lit(False)))
    status = marked.groupBy("p").agg(
        F.bool_and("recombinant").alias("dropped"),
        (F.bool_or("recombinant") & ~F.bool_and("recombinant")).alias("partial"),
    )
    return marked, status


def local_covariance(
    cells: DataFrame, *, n_samples: int, distance: int = 500, fraction: float = 0.98
) -> DataFrame:
    """Sites whose covariance with a focal site is close to the focal's largest one nearby (at least two such).

    The maximum is taken over the neighbourhood (including the focal's own variance), never over all site pairs.
    """
    cells = cells.where("x <> 0")
    pairs = _with_moments(nearby_products(cells, reach=distance, key=("p",)), cells, ("p",))
    n = F.lit(float(n_samples))
    cov = (F.col("sxy") - F.col("sa") * F.col("sb") / n) / (n - 1)
    both = pairs.select(F.col("a.p").alias("f"), F.col("b.p").alias("m"), cov.alias("c"))
    own = cells.groupBy("p").agg(
        ((F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / n) / (n - 1)).alias("c")
    )
    rows = (
        both.unionByName(both.select(F.col("m").alias("f"), F.col("f").alias("m"), "c"))
        .unionByName(own.select(F.col("p").alias("f"), F.col("p").alias("m"), "c"))
    )
    top = rows.groupBy("f").agg(F.max("c").alias("top"))
    close = rows.join(top, "f").where((F.col("c") > F.col("top") * fraction) & (F.col("top") > 1e-12))
    paired = close.groupBy("f").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return close.join(paired, "f", "left_semi").select(F.col("m").alias("p")).distinct()


def mask_recomb_intervals(
    calls: DataFrame, intervals: DataFrame, contigs: DataFrame, *, padding: int = 0, per_sample: bool = True, width: int = 4096, salt: int = 1
) -> DataFrame:
    """Set calls to NULL inside recombination intervals given in padded coordinates.

    calls: contig_idx (1-based), p, sample, call. intervals: start, end, taxa (blank separated). The k-th contig is
    shifted by ``(k - 1) * padding``. With ``per_sample`` only the listed taxa are masked.
    """
    shifted = calls.withColumn("_pp", F.col("p") + (F.col("contig_idx") - 1) * padding)
    if per_sample:
        rows = intervals.select(
            F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.split(F.trim("taxa"), " +")).alias("sample")
        )
        spans = merge_intervals(rows, keys=["sample"], start="_s", end="_e")
        on = ["sample"]
    else:
        spans = merge_intervals(intervals.select(F.col("start").alias("_s"), F.col("end").alias("_e")), keys=[], start="_s", end="_e")
        on = []
    hit = interval_join(
        shifted, spans.select(*on, "region_start", "region_end"), point="_pp", start="region_start", end="region_end",
        on=on, width=width, how="left", salt=salt,
    )
    return hit.select(
        *[c for c in calls.columns if c != "call"],
        F.when(F.col("region_start").isNull(), F.col("call")).alias("call"),
        F.col("region_start").isNotNull().alias("recombinant"),
    )


def depth_segments(intervals: DataFrame, *, tile_width: int = 100_000, members: bool = False, width: int = 4096) -> DataFrame:
    """Sweep over sample intervals: maximal segments between boundaries with the number of active samples.

    Overlapping intervals of one sample count once (merged first). Boundaries are summed per position before the
    tiled running sum, so a position shared by very many intervals is one row.
    """
    merged = merge_intervals(intervals, keys=["sample"], start="start", end="end", tile_width=tile_width).where(
        F.col("region_end") > F.col("region_start")
    )
    steps = (
        merged.select(F.explode(F.array(
            F.struct(F.col("region_start").alias("pos"), F.lit(1).cast("long").alias("d")),
            F.struct(F.col("region_end").alias("pos"), F.lit(-1).cast("long").alias("d")),
        )).alias("e"))
        .groupBy(F.col("e.pos").alias("pos"))
        .agg(F.sum("e.d").alias("d"))
        .withColumn("neg", -F.col("pos"))
    )
    level = running(
        steps, keys=[], order="pos", tile=bin_of(F.col("pos"), tile_width), values={"active": ("sum", "d", True)}
    )
    ahead = running(
        level, keys=[], order="neg", tile=-bin_of(F.col("pos"), tile_width), values={"next": ("min", "pos", False)}
    )
    out = ahead.where(F.col("active") > 0).select(
        F.col("pos").alias("start"), F.col("next").alias("end"), F.col("active").alias("n_active")
    )
    if members:
        spans = merged.select("sample", "region_start", "region_end")
        out = (
            interval_join(out, spans, point="start", start="region_start", end="region_end", width=width)
            .groupBy("start", "end", "n_active")
            .agg(F.array_sort(F.collect_set("sample")).alias("samples"))
        )
    return out


def depth_shares(segments: DataFrame, *, n_samples: int | Column) -> DataFrame:
    """Bases per number of active samples and the share of covered bases with at least that many.

    One row per distinct depth (bounded by the samples), so the closing window is small.
    """
    sizes = segments.groupBy("n_active").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("n_active")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(1))
    return sizes.select(
        "n_active",
        "bases",
        (F.col("n_active") / n_samples).alias("share_samples"),
        (F.sum("bases").over(down) / F.sum("bases").over(whole)).alias("cum_share"),
    )
