"""Taxonomic report and assembly tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variascope.plans.scan import numbered, running, value_tiles


def top_hit(tax: DataFrame) -> DataFrame:
    """Best taxon per sample (ties: smallest name) as one map-side combined aggregate."""
    best = F.min(F.struct((-F.col("pct")).alias("np"), "taxon"))
    return tax.groupBy("sample").agg(best.alias("b")).select(
        "sample", F.col("b.taxon").alias("taxon"), (-F.col("b.np")).alias("pct")
    )


def top_k(tax: DataFrame, k: int = 3) -> DataFrame:
    """The k best taxa per sample. ``row_number <= k`` is limited per task before the shuffle."""
    order = Window.partitionBy("sample").orderBy(F.desc("pct"), "taxon")
    return tax.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def typing_candidates(tops: DataFrame, schemes: DataFrame) -> DataFrame:
    """Samples whose best taxon has a typing scheme; the scheme's taxon is its name before ``#``."""
    named = schemes.withColumn("taxon", F.get(F.split("scheme", "#"), F.lit(0)))
    return tops.join(named, "taxon").select("sample", "taxon", "scheme")


def expected_taxa(report: DataFrame, manifest: DataFrame, lineages: DataFrame, *, controls: str) -> DataFrame:
    """Report rows for the taxon expected of the sample, with lineage; unknown subject named; controls left out."""
    return (
        report.join(manifest, ["sample", "taxon"])
        .join(lineages, "taxon")
        .where(~F.col("sample").rlike(controls))
        .fillna("unknown", ["subject"])
    )


def pass_ratio(expected: DataFrame, *, cutoff: float = 80) -> DataFrame:
    good = F.col("pct") >= cutoff
    return expected.groupBy("subject", "taxon").agg(
        F.avg(F.when(good, 1.0).otherwise(0.0)).alias("ratio"), F.count_if(good).alias("n_pass")
    )


def fail_list(report: DataFrame, manifest: DataFrame, *, cutoff: float = 80, controls: str) -> DataFrame:
    """Low or unexpected classifications outside controls, with the expected taxon."""
    rows = report.join(manifest.withColumnRenamed("taxon", "expected"), "sample", "left")
    low = (F.col("pct") < cutoff) & (F.col("taxon") == F.col("expected"))
    other = F.col("expected").isNull() | (F.col("taxon") != F.col("expected"))
    return rows.where((F.coalesce(low, F.lit(False)) | other) & ~F.col("sample").rlike(controls))


def contaminant_summary(failed: DataFrame) -> DataFrame:
    """Count and (approximation-free) median percentage per contaminant taxon, percentages in hundredths."""
    cents = F.round(F.col("pct") * 100).cast("long")
    return failed.groupBy("taxon").agg(
        F.count(F.lit(1)).alias("n"), (F.percentile(cents, F.lit(0.5)) / 100).alias("median_pct")
    )


def rank_vs_rank(tax: DataFrame, parents: DataFrame, *, low: str, high: str) -> DataFrame:
    """Percentage of a low-rank taxon next to the percentage of its high-rank parent in the same sample."""
    lower = tax.where(F.col("rank") == low).select("sample", "taxon", F.col("pct").alias("low_pct"))
    upper = tax.where(F.col("rank") == high).select("sample", F.col("taxon").alias("parent"), F.col("pct").alias("high_pct"))
    return lower.join(parents, "taxon").join(upper, ["sample", "parent"], "left")


def pct_histogram(tax: DataFrame) -> DataFrame:
    return tax.groupBy("taxon", F.floor("pct").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def clean_contigs(contigs: DataFrame, *, min_len: int = 500, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(kept, low coverage) contigs relative to the coverage of the assembly's first contig."""
    first = contigs.groupBy("assembly").agg(F.min_by("cov", "idx").alias("first_cov"))
    rows = contigs.join(first, "assembly").where(F.col("len") >= min_len)
    deep = F.col("cov") >= F.col("first_cov") * share
    return rows.where(deep).drop("first_cov"), rows.where(~deep).drop("first_cov")


def centre_slice(seq: Column, size: int = 1000) -> Column:
    """The middle ``size`` bases, or the whole sequence when it is not longer."""
    at = F.floor(F.length(seq) / 2) - size // 2
    return F.when(F.length(seq) > size, F.substring(seq, (at + 1).cast("int"), F.lit(size))).otherwise(seq)


def species_of(title: Column) -> Column:
    return F.array_join(F.slice(F.split(F.trim(title), "\\s+"), 1, 2), " ")


def rank_hits(hits: DataFrame, *, max_evalue: float = 0.05, keys: Sequence[str] = ("genome", "contig")) -> DataFrame:
    """Significant hits numbered per contig by bit score, e-value, identity, accession; tiled along the bit score."""
    good = hits.where(F.col("evalue") < max_evalue).withColumn("species", species_of(F.col("title")))
    down = good.withColumn("_down", -F.col("bitscore"))
    order = [F.col("_down"), F.col("evalue"), F.desc("identity"), F.col("acc")]
    return numbered(down, keys=keys, order=order, tile=value_tiles(down, "_down", 16), name="rank").drop("_down")


def target_vs_other(hits: DataFrame, targets: DataFrame, *, max_evalue: float = 0.05) -> DataFrame:
    """Best target and best other hit per contig and how much better the other one is (never below 0)."""
    rows = (
        hits.where(F.col("evalue") < max_evalue)
        .withColumn("species", species_of(F.col("title")))
        .join(targets, "genome")
    )

    def best(wanted: Column, suffix: str) -> DataFrame:
        key = F.struct((-F.col("bitscore")).alias("b"), "evalue", (-F.col("identity")).alias("i"), "acc")
        top = F.min_by(F.struct("species", "identity"), key)
        return rows.where(wanted).groupBy("genome", "contig").agg(top.alias("t")).select(
            "genome", "contig", F.col("t.species").alias(f"species_{suffix}"), F.col("t.identity").alias(f"identity_{suffix}")
        )

    own = F.col("species") == F.col("target")
    both = best(own, "target").join(best(~own, "other"), ["genome", "contig"], "full_outer")
    gap = (
        F.when(F.col("identity_other").isNull(), 0.0)
        .when(F.col("identity_target").isNull(), F.col("identity_other"))
        .otherwise(F.greatest(F.col("identity_other") - F.col("identity_target"), F.lit(0.0)))
    )
    missing = F.col("identity_other").isNull()
    return both.select(
        "genome", "contig", "species_target", "identity_target",
        F.when(missing, "NA").otherwise(F.col("species_other")).alias("species_other"),
        F.coalesce("identity_other", F.lit(0.0)).alias("identity_other"),
        gap.alias("pident_diff"),
    )


def n50_l50(contigs: DataFrame, *, tile: int = 4096) -> DataFrame:
    """N50 and L50 per assembly from the histogram of lengths, so equal lengths are one row; null lengths do not count."""
    hist = contigs.where("len IS NOT NULL").groupBy("assembly", "len").agg(F.count(F.lit(1)).alias("n"))
    rows = hist.withColumn("neg", -F.col("len")).withColumn("bases", F.col("len") * F.col("n"))
    cum = running(
        rows, keys=["assembly"], order="neg", tile=F.floor(F.col("neg") / tile),
        values={"before": ("sum", "bases", False), "rank": ("sum", "n", False)},
    )
    half = contigs.groupBy("assembly").agg(F.bround(F.sum("len") / 2, 0).alias("half"))
    reached = cum.join(half, "assembly").where(F.col("before") + F.col("bases") >= F.col("half"))
    # all rows behind half the bases are here, empty contigs too; of those the first one is enough
    need = F.when(F.col("len") > 0, F.greatest(F.ceil((F.col("half") - F.col("before")) / F.col("len")), F.lit(1))).otherwise(1)
    return reached.groupBy("assembly").agg(F.max(F.struct("len", (F.col("rank") + need).cast("long").alias("l50"))).alias("m")).select(
        "assembly", F.col("m.len").alias("n50"), F.col("m.l50").alias("l50")
    )


def weighted_cov(contigs: DataFrame, *, min_len: int = 500) -> DataFrame:
    """Exact length-weighted mean and sd of coverage, with contig count, maximum, mean and median length."""
    long = contigs.where(F.col("len") > min_len)
    w = F.sum("len")
    mean = F.sum(F.col("len") * F.col("cov")) / w
    var = F.sum(F.col("len") * F.col("cov") * F.col("cov")) / w - mean * mean
    return long.groupBy("assembly").agg(
        mean.alias("mean_cov"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd_cov"),
        F.count(F.lit(1)).alias("n_contigs"),
        F.max("len").alias("max_len"),
        F.avg("len").alias("mean_len"),
        F.percentile("len", F.lit(0.5)).alias("median_len"),
    )


def merge_stats(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables under one header; absent columns are NULL."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
