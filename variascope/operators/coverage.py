"""Coverage tables: candidate cells, normalisation, histograms, masks.

Coverage is sparse, ``sample, p, cov`` with absent = 0. Statistics that need the zeros use the explicit
genome length instead of materialised zero rows. Normalised coverage is kept as a model: a constant per sample, two moments
per position and one value per covered cell give every cell of the matrix, and runs past a threshold are read off the steps of
the position's bound without visiting the cells in between. Cells without reads appear only where they are the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variascope.operators.calls import COUNTS
from variascope.plans.grid import filled
from variascope.plans.intervals import interval_join
from variascope.plans.lineage import cut
from variascope.plans.scan import running


def gather_cells(sites: DataFrame, samples: DataFrame, cells: DataFrame) -> DataFrame:
    """Candidate table with every site of every sample, absent counts 0: cells at the sites, and rows for what is absent."""
    values = [c for c in cells.columns if c not in ("sample", "p")]
    there = cells.join(sites.select("p"), "p", "left_semi").join(samples.select("sample"), "sample", "left_semi")
    return filled(there, samples.select("sample"), sites.select("p"), key="sample", item="p").fillna(0, subset=values)


def coverage_per_base(cells: DataFrame) -> DataFrame:
    total = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    return cells.select("sample", "p", total.cast("long").alias("cov"))


def sample_moments(cov: DataFrame, samples: DataFrame, n_positions: int) -> DataFrame:
    """Mean and population sd of each sample over all positions, zeros included."""
    sums = cov.groupBy("sample").agg(F.sum("cov").alias("s1"), F.sum(F.col("cov") * F.col("cov")).alias("s2"))
    mean = F.coalesce("s1", F.lit(0)) / F.lit(float(n_positions))
    return samples.select("sample").join(sums, "sample", "left").select(
        "sample",
        mean.alias("mean"),
        F.sqrt(F.greatest(F.coalesce("s2", F.lit(0)) / F.lit(float(n_positions)) - mean * mean, F.lit(0.0))).alias("sd"),
    )


@dataclass
class ZModel:
    """Double z scores of all samples x positions without the matrix.

    ``constants``: sample, mean, sd, z0 (first score of a position without reads). ``places``: p, m, s for every position, mean and
    sd of the first scores over samples (s null if they do not vary). ``cells``: sample, p, z1 of covered cells.
    The score of a cell is 1000 * (first score - m) / s, rounded half-even; 0 where s is null.
    """

    constants: DataFrame
    places: DataFrame
    cells: DataFrame
    n_positions: int

    def dense(self, *, tile: int = 1 << 16) -> DataFrame:
        """(sample, p, z) of all cells."""
        tiles = F.sequence(F.lit(0), F.lit((self.n_positions - 1) // tile))
        parts = self.constants.select("sample", "z0", F.explode(tiles).alias("_t")).repartition("sample", "_t")
        begin = F.col("_t").cast("long") * tile
        rows = parts.select("sample", "z0", F.explode(F.sequence(begin, F.least(begin + tile, F.lit(self.n_positions)) - 1)).alias("p"))
        rows = rows.join(self.places, "p").join(self.cells, ["sample", "p"], "left")
        return rows.select("sample", "p", score(F.coalesce("z1", "z0")).alias("z"))

    def runs(self, *, below: int | None = None, above: int | None = None, min_length: int, tile_width: int = 100_000, grain: int = 64) -> DataFrame:
        """(sample, start, end) of the maximal runs, longer than ``min_length``, of scores below or above a negative or positive bound.

        For a position without reads the test is a comparison of the sample's constant with a bound of the position, so a
        sample enters or leaves a run where the bound steps over its constant: an interval join of constants and steps. Next
        to covered cells the test is made itself.
        """
        sign, bound = (1, below) if below is not None else (-1, above)
        if sign * bound >= 0:
            raise ValueError("a run below needs a negative bound, one above a positive one")
        # rounded score < bound, on the scale of first scores times sign
        edge = sign * F.col("m") + F.col("s") * ((sign * bound - 0.5) / 1000)
        lowest = F.lit(float("-inf"))
        own = self.constants.select("sample", (F.col("z0") * sign).alias("c"))
        span = own.agg(F.struct(F.min("c").alias("lo"), F.max("c").alias("hi")).alias("s"))
        bounds = self.places.select("p", F.coalesce(edge, lowest).alias("edge"))
        after = bounds.select((F.col("p") + 1).alias("p"), F.col("edge").alias("before"))
        steps = cut(bounds.join(after, "p", "full").select("p", F.coalesce("before", lowest).alias("before"), F.coalesce("edge", lowest).alias("edge")))
        # constants c with before <= c < edge enter at p, those with edge <= c < before leave: c < edge is the test
        low, high = F.least("before", "edge"), F.greatest("before", "edge")
        bins = F.sequence(
            F.floor(F.greatest(low, F.col("_s.lo")) * grain), F.floor(F.least(high, F.col("_s.hi")) * grain)
        )
        reach = steps.withColumn("_s", span.scalar()).where((high > F.col("_s.lo")) & (low <= F.col("_s.hi")) & (low < high))
        stepped = reach.withColumn("_b", F.explode(bins)).select("p", "before", "edge", "_b")
        hit = own.withColumn("_b", F.floor(F.col("c") * grain)).join(stepped, "_b").where((F.col("c") >= low) & (F.col("c") < high))
        model = hit.select("sample", "p", (F.col("edge") > F.col("before")).alias("opens"))
        # both edges of covered cells
        cells = self.cells.select("sample", "p", (F.col("z1") * sign).alias("c1"))
        near = cells.select("sample", F.explode(F.array("p", F.col("p") + 1)).alias("p")).distinct()
        left = cells.select("sample", (F.col("p") + 1).alias("p"), F.col("c1").alias("c0"))
        tested = near.join(own, "sample").join(cells, ["sample", "p"], "left").join(left, ["sample", "p"], "left").join(steps, "p")
        was, now = F.coalesce("c0", "c") < F.col("before"), F.coalesce("c1", "c") < F.col("edge")
        exact = tested.where(was != now).select("sample", "p", now.alias("opens"))
        edges = model.join(near, ["sample", "p"], "left_anti").unionByName(exact)
        edges = edges.withColumn("_at", F.when(F.col("opens"), F.col("p")))
        paired = running(edges, keys=["sample"], order="p", tile=F.floor(F.col("p") / tile_width), values={"start": ("max", "_at", True)})
        ends = paired.where(~F.col("opens")).select("sample", "start", F.col("p").alias("end"))
        return ends.where(F.col("end") - F.col("start") > min_length)

    def means(self, regions: DataFrame) -> DataFrame:
        """Mean score of each (sample, start, end): only the positions of regions are visited."""
        inside = regions.select("sample", "start", "end").join(self.constants.select("sample", "z0"), "sample")
        inside = inside.withColumn("p", F.explode(F.sequence("start", F.col("end") - 1)))
        rows = inside.join(self.places, "p").join(self.cells, ["sample", "p"], "left")
        return rows.groupBy("sample", "start", "end").agg(F.avg(score(F.coalesce("z1", "z0"))).alias("mean_z"))


def score(first: Column) -> Column:
    return F.coalesce(F.bround((first - F.col("m")) / F.col("s") * 1000, 0), F.lit(0.0)).cast("long")


def z_model(cov: DataFrame, samples: DataFrame, n_positions: int) -> ZModel:
    """Per-sample z over all positions, then per-position z over samples.

    Position moments come from the covered cells alone: a zero cell of a sample has the constant z0 of that sample,
    so sums over samples are the sum of all z0 plus corrections from covered cells.
    """
    moments = sample_moments(cov, samples, n_positions)
    z0 = F.when(F.col("sd") > 0, -F.col("mean") / F.col("sd")).otherwise(F.lit(0.0))
    moments = cut(moments.withColumn("z0", z0))
    totals = moments.agg(
        F.struct(F.sum("z0").alias("a"), F.sum(F.col("z0") * F.col("z0")).alias("b"), F.count(F.lit(1)).alias("n")).alias("t")
    ).scalar()
    covered = cov.join(moments, "sample").withColumn(
        "z1", F.when(F.col("sd") > 0, (F.col("cov") - F.col("mean")) / F.col("sd")).otherwise(F.lit(0.0))
    )
    shifts = covered.groupBy("p").agg(
        F.sum(F.col("z1") - F.col("z0")).alias("d1"),
        F.sum(F.col("z1") * F.col("z1") - F.col("z0") * F.col("z0")).alias("d2"),
    )
    rows = cov.sparkSession.range(n_positions).select(F.col("id").alias("p")).join(shifts, "p", "left").withColumn("_t", totals)
    mean = (F.col("_t.a") + F.coalesce("d1", F.lit(0.0))) / F.col("_t.n")
    var = (F.col("_t.b") + F.coalesce("d2", F.lit(0.0))) / F.col("_t.n") - mean * mean
    places = cut(rows.select("p", mean.alias("m"), F.when(var > 1e-12, F.sqrt(var)).alias("s")))
    return ZModel(moments, places, covered.select("sample", "p", "z1"), n_positions)


def double_zscore(cov: DataFrame, samples: DataFrame, n_positions: int) -> DataFrame:
    """The integer matrix in long form."""
    return z_model(cov, samples, n_positions).dense()


def depth_histogram(cov: DataFrame, samples: DataFrame, n_positions: int) -> DataFrame:
    """(sample, depth, n) including the zero bin; rows per sample are bounded by the distinct depths."""
    seen = cov.where("cov > 0").groupBy("sample", F.col("cov").alias("depth")).agg(F.count(F.lit(1)).alias("n"))
    zeros = samples.select("sample").join(seen.groupBy("sample").agg(F.sum("n").alias("k")), "sample", "left").select(
        "sample", F.lit(0).cast("long").alias("depth"), (F.lit(n_positions) - F.coalesce("k", F.lit(0))).alias("n")
    )
    return seen.unionByName(zeros.where("n > 0"))


def _moments(total):
    mean = F.sum(F.col("depth") * F.col("n")) / total
    var = F.sum(F.col("depth") * F.col("depth") * F.col("n")) / total - mean * mean
    return mean, F.sqrt(F.greatest(var, F.lit(0.0)))


def histogram_cumulative(hist: DataFrame) -> DataFrame:
    """Bases with depth >= 1..10, then median, mean and sd truncated to integers."""
    total = F.sum("n")
    mean, sd = _moments(total)
    bins = [
        F.sum(F.when(F.col("depth") >= t, F.col("n")).otherwise(0)).alias(f"ge{t}") for t in range(1, 11)
    ]
    return hist.groupBy("sample").agg(
        *bins,
        F.percentile("depth", F.lit(0.5), F.col("n")).cast("long").alias("median"),
        mean.cast("long").alias("mean"),
        sd.cast("long").alias("sd"),
    )


def histogram_exact(hist: DataFrame) -> DataFrame:
    """Bases with depth 0..9 and >= 10, then weighted (lower) median, mean and sd truncated to integers."""
    along = Window.partitionBy("sample").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("sample")
    ranked = hist.withColumn("cum", F.sum("n").over(along)).withColumn("tot", F.sum("n").over(whole))
    total = F.sum("n")
    mean, sd = _moments(total)
    bins = [
        F.sum(F.when((F.col("depth") == t) if t < 10 else (F.col("depth") >= 10), F.col("n")).otherwise(0)).alias(f"b{t}")
        for t in range(11)
    ]
    return ranked.groupBy("sample").agg(
        *bins,
        F.min(F.when(F.col("cum") >= F.col("tot") / 2, F.col("depth"))).alias("median"),
        mean.cast("long").alias("mean"),
        sd.cast("long").alias("sd"),
    )


def bases_covered(hist: DataFrame, *, at_least: int = 4) -> DataFrame:
    return hist.groupBy("sample").agg(
        F.sum(F.when(F.col("depth") >= at_least, F.col("n")).otherwise(0)).alias("callable")
    )


def mean_sd_above(cov: DataFrame, *, threshold: float) -> DataFrame:
    value = F.when(F.col("cov") > threshold, F.col("cov"))
    return cov.groupBy("sample").agg(
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("sd")
    )


def median_above_zero(cov: DataFrame, *, key: str = "p") -> DataFrame:
    """Median of the positive integer depths, -1 when there is none."""
    return cov.groupBy(key).agg(
        F.coalesce(F.percentile(F.when(F.col("cov") > 0, F.col("cov")), F.lit(0.5)), F.lit(-1.0)).alias("median")
    )


def core_genome_size(
    cov: DataFrame,
    failed_sites: DataFrame,
    *,
    n_samples: int,
    genome_length: int,
    n_variable: int,
    min_cov: int,
    max_ambiguous: float,
    min_median: float,
    positive_median: bool = True,
) -> DataFrame:
    """Counts of core, invariable, variable and unresolved positions in one row."""
    rows = cov.join(failed_sites.select("p"), "p", "left_anti").where("cov > 0")
    hist = rows.groupBy("p", "cov").agg(F.count(F.lit(1)).alias("n"))
    if not positive_median:
        absent = hist.groupBy("p").agg((F.lit(n_samples) - F.sum("n")).alias("n")).select(
            "p", F.lit(0).cast("long").alias("cov"), "n"
        )
        hist = hist.unionByName(absent.where("n > 0"))
    per_site = hist.groupBy("p").agg(
        (F.lit(n_samples) - F.sum(F.when(F.col("cov") >= min_cov, F.col("n")).otherwise(0))).alias("low"),
        F.percentile("cov", F.lit(0.5), F.col("n")).alias("median"),
    )
    core = F.count_if((F.col("low") < n_samples * max_ambiguous) & (F.col("median") >= min_median))
    return per_site.agg(core.alias("n_core")).select(
        "n_core",
        (F.col("n_core") - n_variable).alias("n_invariable"),
        F.lit(n_variable).cast("long").alias("n_variable"),
        (F.lit(genome_length) - F.col("n_core")).cast("long").alias("n_unresolved"),
    )


def percentile_cutoffs(hist: DataFrame, *, cutoff: float, keys=("sample", "contig")) -> DataFrame:
    """First depth at which the cumulative share of bases exceeds ``1 - cutoff``. ``hist`` has keys, depth, share."""
    along = Window.partitionBy(*keys).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.withColumn("cum", F.sum("share").over(along))
        .where(F.col("cum") > 1 - cutoff)
        .groupBy(*keys)
        .agg(F.min("depth").alias("cutoff"))
    )


def mask_above(cov: DataFrame, cutoffs: DataFrame, *, keys=("sample", "contig")) -> DataFrame:
    return cov.join(cutoffs, list(keys), "left").withColumn(
        "masked", F.coalesce(F.col("cov") > F.col("cutoff"), F.lit(False))
    )


def mask_intervals(
    cells: DataFrame, intervals: DataFrame, *, cutoff: float, on=("sample",), width: int = 4096, salt: int = 1
) -> DataFrame:
    """Cells inside an interval (both ends included) whose uncovered share exceeds the cutoff."""
    holes = intervals.where(F.col("share") > cutoff).withColumn("_stop", F.col("end") + 1)
    return interval_join(
        cells, holes, point="p", start="start", end="_stop", on=on, width=width, how="left_semi", salt=salt
    )


def bin_mean(
    cov: DataFrame, samples: DataFrame, *, width: int, n_positions: int, scale: bool = False
) -> DataFrame:
    """Mean depth per block of ``width`` positions; the last, shorter block is kept. Absent positions count as 0."""
    n_bins = (n_positions + width - 1) // width
    sums = cov.groupBy("sample", F.floor(F.col("p") / width).cast("long").alias("bin")).agg(F.sum("cov").alias("s"))
    grid = samples.select("sample").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    size = F.least(F.lit(width), F.lit(n_positions) - F.col("bin") * width)
    out = grid.join(sums, ["sample", "bin"], "left").select(
        "sample", "bin", (F.coalesce("s", F.lit(0)) / size).alias("mean_cov")
    )
    if scale:
        means = cov.groupBy("sample").agg((F.sum("cov") / F.lit(float(n_positions))).alias("m"))
        out = out.join(means, "sample").select("sample", "bin", (F.col("mean_cov") / F.col("m")).alias("mean_cov"))
    return out


def mapping_qc_table(mapped: DataFrame, dedup: DataFrame) -> DataFrame:
    """Mapping rates joined with duplicate and optical duplicate percentages per sample and reference."""
    return mapped.join(dedup, ["sample", "ref"], "full_outer").select(
        "sample",
        "ref",
        "overall_rate",
        "once_rate",
        (F.col("pair_dups") / F.nullif(F.col("pairs"), F.lit(0)) * 100).alias("duplicate_rate"),
        (F.col("optical_dups") / F.nullif(F.col("pairs"), F.lit(0)) * 100).alias("optical_rate"),
    )
