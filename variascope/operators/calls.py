"""Allele calls, call and site filters, site quality.

Canonical cell row: ``sample, p, n0..n7, fq`` with n0..n3 the forward and n4..n7 the reverse counts of
A, T, C, G and ``fq`` the quality where larger is better. A missing call is NULL inside the library.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variascope.functions.bases import nt, ranked_counts

COUNTS = [f"n{i}" for i in range(8)]


def folded() -> list[Column]:
    return [F.col(f"n{i}") + F.col(f"n{i + 4}") for i in range(4)]


def major_minor_allele(cells: DataFrame) -> DataFrame:
    """Major and minor base with their frequencies, row-local (no shuffle). No reads: NULL call, frequency 0."""
    total = sum(folded()[1:], folded()[0])
    ranked = cells.withColumn("_r", ranked_counts(folded())).withColumn("depth", total.cast("long"))
    has = F.col("depth") > 0

    def share(i: int) -> Column:
        return F.when(has, F.col("_r")[i]["n"] / F.col("depth")).otherwise(F.lit(0.0))

    return ranked.select(
        *cells.columns,
        "depth",
        share(0).alias("major_af"),
        F.when(has, F.col("_r")[0]["idx"]).alias("major_nt"),
        F.when(has, F.col("_r")[1]["idx"]).alias("minor_nt"),
        share(1).alias("minor_af"),
    )


def mutant_af(cells: DataFrame, *, major: str = "major_nt", af: str = "major_af", ref: str = "ref_nt") -> DataFrame:
    """Frequency of the major base where it differs from the reference, else 0 (a missing call counts as different
    with frequency 0)."""
    return cells.withColumn(
        "mutant_af", F.when(F.col(major).isNull() | (F.col(major) != F.col(ref)), F.col(af)).otherwise(F.lit(0.0))
    )


def consensus_allele(calls: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Most frequent known call per site, ties to the lowest base index; two map-side combined aggregations."""
    votes = calls.where(F.col("call").isNotNull()).groupBy("p", "call").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("p").agg(F.max(F.struct("n", (-F.col("call")).alias("neg"))).alias("b")).select(
        "p", (-F.col("b.neg")).alias("consensus"), F.col("b.n").alias("votes")
    )
    if sites is None:
        sites = calls.select("p").distinct()
    return sites.join(best, "p", "left")


def choose_outgroup(calls: DataFrame, *, outgroup: Column) -> DataFrame:
    """Ancestral call per site: the outgroup with fewest missing sites (ties: smallest name), else the consensus of
    all outgroups, else NULL."""
    outs = calls.where(outgroup)
    best = (
        outs.groupBy("sample")
        .agg(F.count_if(F.col("call").isNull()).alias("missing"))
        .agg(F.min(F.struct("missing", "sample")).alias("b"))
        .select(F.col("b.sample").alias("sample"))
    )
    chosen = outs.join(F.broadcast(best), "sample", "left_semi").select("p", F.col("call").alias("best_call"))
    return (
        consensus_allele(outs, calls.select("p").distinct())
        .join(chosen, "p", "left")
        .select("p", "best_call", "consensus", F.coalesce("best_call", "consensus").alias("anc"))
    )


def sample_filter(samples: DataFrame, coverage_stats: DataFrame, *, min_median: float = 8) -> DataFrame:
    """Keep samples whose median coverage reaches the threshold."""
    return samples.join(coverage_stats.where(F.col("median_cov") >= min_median), "sample", "left_semi")


def sample_select(
    samples: DataFrame, *, subject: Column, excluded: DataFrame, outgroup_pattern: str, name: str = "sample"
) -> DataFrame:
    """Samples of a subject minus an exclusion list, plus outgroups by name pattern; adds a zero-padded id."""
    keep = samples.where(subject).join(excluded.select(name).distinct(), name, "left_anti")
    outs = samples.where(F.col(name).rlike(outgroup_pattern))
    return (
        keep.withColumn("is_outgroup", F.lit(False))
        .unionByName(outs.join(keep.select(name), name, "left_anti").withColumn("is_outgroup", F.lit(True)))
        .withColumn("padded", F.lpad(F.regexp_replace(name, "^\\D+0*(?=\\d)", ""), 6, "0"))
    )


def call_failures(
    *, min_fq: float = 30, min_af: float = 0.95, min_strand: int = 2, max_indel_share: float = 0.5
) -> dict[str, Column]:
    """The four call filters as named predicates on a cell row with major_af, depth and indel_n."""
    forward = F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")
    reverse = F.col("n4") + F.col("n5") + F.col("n6") + F.col("n7")
    return {
        "low_fq": F.col("fq") < min_fq,
        "low_af": F.col("major_af") < min_af,
        "low_cov": (forward < min_strand) | (reverse < min_strand),
        "indel": F.col("indel_n") > max_indel_share * F.col("depth"),
    }


def cell_filter(cells: DataFrame, failures: dict[str, Column]) -> DataFrame:
    """Set ``call`` to NULL where any filter fails; one projection."""
    bad = F.lit(False)
    for predicate in failures.values():
        bad = bad | F.coalesce(predicate, F.lit(False))
    return cells.withColumn("call", F.when(~bad, F.col("major_nt")))


def filter_loss_report(cells: DataFrame, failures: dict[str, Column]) -> DataFrame:
    """Per sample the percentage of known calls removed by each filter alone."""
    known = F.col("major_nt").isNotNull()
    total = F.count_if(known)
    return cells.groupBy("sample").agg(
        total.alias("calls"),
        *[
            F.when(total > 0, F.count_if(known & bad) * 100.0 / total).alias(f"pct_{name}")
            for name, bad in failures.items()
        ],
    )


def site_filter(
    calls: DataFrame,
    *,
    max_ambiguous: float,
    min_median: float,
    positive_median: bool = True,
    n_samples: int | Column | None = None,
) -> DataFrame:
    """Sites with few missing calls and enough (positive) median coverage. Coverage is an integer, so the exact
    percentile buffer is bounded by the number of distinct depths."""
    depth = F.when(F.col("depth") > 0, F.col("depth")) if positive_median else F.col("depth")
    count = F.count(F.lit(1)) if n_samples is None else (n_samples if isinstance(n_samples, Column) else F.lit(n_samples))
    stats = calls.groupBy("p").agg(
        F.count_if(F.col("call").isNull()).alias("n_missing"),
        count.alias("n_samples") if n_samples is None else F.max(count).alias("n_samples"),
        F.coalesce(F.percentile(depth, F.lit(0.5)), F.lit(-1.0)).alias("median_cov"),
    )
    return stats.where(
        (F.col("n_missing") < F.col("n_samples") * max_ambiguous) & (F.col("median_cov") >= min_median)
    )


def site_quality(calls: DataFrame) -> DataFrame:
    """Best over disagreeing sample pairs of the lower quality of the pair, without forming pairs.

    For a pair of alleles the best pair takes each allele's best sample, so the answer is the second largest of
    the per-allele maxima. The reported samples are each allele's best (ties: smallest sample, then lowest base).
    Sites with a single allele get quality -1.
    """
    # missing calls are a group of their own, so that a site without any call still has a row
    per_allele = calls.groupBy("p", "call").agg(
        F.max("fq").alias("q"), F.min_by("sample", F.struct(-F.col("fq"), F.col("sample"))).alias("s")
    )
    known = F.when(F.col("call").isNotNull(), F.struct((-F.col("q")).alias("nq"), "call", "s"))
    top = per_allele.groupBy("p").agg(F.sort_array(F.collect_list(known)).alias("a"))
    second = F.get("a", F.lit(1))
    return top.select(
        "p",
        F.coalesce(-second["nq"], F.lit(-1.0)).alias("mut_qual"),
        F.when(second.isNotNull(), F.get("a", F.lit(0))["s"]).alias("sample_a"),
        second["s"].alias("sample_b"),
    )


def has_mutation(calls: DataFrame, site_quality: DataFrame, ref: DataFrame, *, min_quality: float = 1) -> DataFrame:
    """Flag known calls that differ from the reference at sites of sufficient quality (ingroup rows only)."""
    return (
        calls.join(site_quality.select("p", "mut_qual"), "p")
        .join(ref, "p")
        .withColumn(
            "mutated",
            F.coalesce(
                F.col("call").isNotNull() & (F.col("call") != F.col("ref_nt")) & (F.col("mut_qual") >= min_quality),
                F.lit(False),
            ),
        )
    )


def candidate_sites(flagged: DataFrame) -> DataFrame:
    return flagged.where("mutated").groupBy("p").agg(F.count(F.lit(1)).alias("n_mutated"))


def burden_tables(flagged: DataFrame) -> DataFrame:
    """Mutated sites per sample and mutated samples per site in one pass with grouping sets (zeros included)."""
    return flagged.groupingSets(
        [["sample"], ["p"]], "sample", "p"
    ).agg(F.count_if("mutated").alias("n_mutated"))


def filter_combinations_within(cells: DataFrame, masks: Sequence[Column], *, base: Column, site: str = "p") -> DataFrame:
    """For every non-empty subset of cell filters: sites where each cell is unmutated or removed by the subset.

    Each cell keeps a bit mask. A site is lost under subset s when every mutated cell hits s. Cells are first
    reduced to distinct (site, mask), at most 2^k rows per site, before subsets are expanded.
    """
    k = len(masks)
    bits = sum((F.when(m, F.lit(1 << i)).otherwise(0) for i, m in enumerate(masks)), F.lit(0))
    per_site = cells.withColumn("_m", F.when(base, F.lit((1 << k))).otherwise(bits)).groupBy(site).agg(
        F.collect_set("_m").alias("_ms")
    )
    subsets = F.sequence(F.lit(1), F.lit((1 << k) - 1))
    return (
        per_site.withColumn("subset", F.explode(subsets))
        .groupBy("subset")
        .agg(
            F.count_if(
                F.forall("_ms", lambda m: (m.bitwiseAND(F.lit(1 << k)) != 0) | (m.bitwiseAND(F.col("subset")) != 0))
            ).alias("n_sites")
        )
    )


def filter_combinations_across(sites: DataFrame, masks: Sequence[Column]) -> DataFrame:
    """For every non-empty subset of site filters: sites removed by at least one of them."""
    k = len(masks)
    bits = sum((F.when(m, F.lit(1 << i)).otherwise(0) for i, m in enumerate(masks)), F.lit(0))
    by_mask = sites.groupBy(bits.alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        by_mask.withColumn("subset", F.explode(F.sequence(F.lit(1), F.lit((1 << k) - 1))))
        .groupBy("subset")
        .agg(F.sum(F.when(F.col("_m").bitwiseAND(F.col("subset")) != 0, F.col("_n")).otherwise(0)).alias("n_sites"))
    )


def indel_filter(
    indels: DataFrame,
    *,
    min_cov: int = 3,
    min_share: float = 0.8,
    max_gap: float = -10,
    max_intermediate: float = 0.2,
) -> DataFrame:
    """Keep sites with both supported alternate and supported reference samples and few intermediate ones.

    Row: p, sample, dp_ref, dp_alt, dp, gl_ref, gl_alt, size. ``gl_ref - gl_alt`` is the likelihood gap.
    """
    share_alt = F.when(F.col("dp") > 0, F.col("dp_alt") / F.col("dp")).otherwise(F.lit(0.0))
    share_ref = F.when(F.col("dp") > 0, F.col("dp_ref") / F.col("dp")).otherwise(F.lit(0.0))
    deep = F.col("dp") >= min_cov
    flagged = indels.withColumn(
        "has_indel",
        deep & (F.col("size") != 0) & (share_alt > min_share) & (F.col("gl_ref") - F.col("gl_alt") <= max_gap),
    ).withColumn("has_ref", deep & (share_ref > min_share))
    mid = deep & (share_alt <= min_share) & (share_ref <= min_share)
    sites = (
        flagged.groupBy("p")
        .agg(
            F.count_if("has_indel").alias("n_alt"),
            F.count_if("has_ref").alias("n_ref"),
            F.count_if(mid).alias("n_mid"),
            F.count(F.lit(1)).alias("n"),
        )
        .where((F.col("n_mid") < F.col("n") * max_intermediate) & (F.col("n_alt") > 0) & (F.col("n_ref") > 0))
    )
    return flagged.join(sites.select("p"), "p", "left_semi")


def best_alternate(rows: DataFrame, likelihoods: str) -> DataFrame:
    """Index and value of the largest likelihood after the first (reference) entry; ties to the higher index."""
    ranked = F.array_max(
        F.transform(
            F.slice(F.col(likelihoods), F.lit(2), F.size(likelihoods) - 1),
            lambda g, i: F.struct(g.alias("gl"), (i + 1).alias("idx")),
        )
    )
    return rows.withColumn("_b", ranked).withColumn("alt_idx", F.col("_b.idx")).withColumn("gl_alt", F.col("_b.gl")).drop("_b")


def indel_call(has_indel: Column, has_ref: Column, alt: Column, ref: Column) -> Column:
    return F.when(has_indel, alt).when(has_ref, ref).otherwise(F.lit("?"))


def binned_quality_rates(flagged: DataFrame, value: Column, edges: Sequence[float]) -> DataFrame:
    """Per sample the share of its mutated sites in each value bin (lower edge included)."""
    mutated = flagged.where("mutated").withColumn("_v", value)
    total = F.count(F.lit(1))
    cols = []
    bounds = [*edges, None]
    for i, low in enumerate(edges):
        high = bounds[i + 1]
        inside = (F.col("_v") >= low) & (F.lit(True) if high is None else F.col("_v") < high)
        cols.append((F.count_if(inside) / total).alias(f"bin{i}"))
    return mutated.groupBy("sample").agg(total.alias("n"), *cols)


def frame_rates(flagged: DataFrame, *, frame: int, missing: bool = False) -> DataFrame:
    """Mutated (or missing) sites per sample and genome frame of fixed width, as a share of the sample's sites."""
    wanted = F.col("call").isNull() if missing else F.col("mutated")
    per_frame = flagged.groupBy("sample", F.floor(F.col("p") / frame).cast("long").alias("frame")).agg(
        F.count_if(wanted).alias("hits"), F.count(F.lit(1)).alias("sites")
    )
    return per_frame.withColumn("share", F.col("hits") / F.col("sites"))


def strand_depth_table(cells: DataFrame) -> DataFrame:
    """Long table of reads per base and strand for every site and sample."""
    return cells.select(
        "p",
        "sample",
        F.explode(
            F.array(
                *[
                    F.struct(
                        nt(F.lit(i % 4)).alias("base"),
                        F.lit("fwd" if i < 4 else "rev").alias("strand"),
                        F.col(f"n{i}").cast("long").alias("reads"),
                    )
                    for i in range(8)
                ]
            )
        ).alias("e"),
    ).select("p", "sample", "e.*")


def polarization_report(calls: DataFrame, *, outgroup: Column) -> DataFrame:
    """Unresolved sites and resolved share for each outgroup and for their combination."""
    outs = calls.where(outgroup)
    single = outs.groupBy("sample").agg(
        F.count_if(F.col("call").isNull()).alias("unresolved"), F.count(F.lit(1)).alias("sites")
    )
    combined = (
        outs.groupBy("p")
        .agg(F.max("call").alias("c"))
        .agg(F.count_if(F.col("c").isNull()).alias("unresolved"), F.count(F.lit(1)).alias("sites"))
        .select(F.lit(None).cast(outs.schema["sample"].dataType).alias("sample"), "unresolved", "sites")
    )
    return single.unionByName(combined).withColumn("resolved_share", 1 - F.col("unresolved") / F.col("sites"))
