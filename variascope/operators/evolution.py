"""Codon usage, expected and observed selection, Monte-Carlo null tables, spectra."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variascope.functions import tails
from variascope.functions.bases import CODON_TO_AA, triplets
from variascope.operators.annotate import site_to_one_gene
from variascope.operators.tree import SUBSTITUTIONS
from variascope.plans.intervals import interval_join
from variascope.plans.scan import value_ranks, value_tiles


def codon_usage(genes: DataFrame, *, by: Sequence[str] = (), offset: str | None = None) -> DataFrame:
    """Count and share of each known codon, over all genes or per ``by``. Offset is in codons."""
    seq = F.col("seq") if offset is None else F.substring(F.col("seq"), F.col(offset) * 3 + 1, F.length("seq"))
    codons = genes.select(*by, F.explode(triplets(seq)).alias("codon"))
    counts = codons.where(F.col("codon").rlike("^[ATCG]{3}$")).groupBy(*by, "codon").agg(F.count(F.lit(1)).alias("n"))
    # at most 64 counts per window
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    return counts.select(*by, "codon", "n", (F.col("n") / total).alias("share"))


def nonsyn_table(spark: SparkSession) -> DataFrame:
    """64 codons x 12 substitutions: occurrences of the mutated base and the share that changes the amino acid."""
    rows = []
    for codon, aa in CODON_TO_AA.items():
        for sub in SUBSTITUTIONS:
            at = [i for i in range(3) if codon[i] == sub[0]]
            changed = sum(CODON_TO_AA[codon[:i] + sub[1] + codon[i + 1 :]] != aa for i in at)
            rows.append((codon, sub, len(at), changed / len(at) if at else None))
    return spark.createDataFrame(rows, "codon string, sub string, bases int, p_nonsyn double")


def expected_pn(
    usage: DataFrame, table: DataFrame, *, by: Sequence[str] = (), spectrum: Mapping[str, float] | None = None
) -> DataFrame:
    """Probability that a mutation is nonsynonymous under codon usage and spectrum (uniform by default).

    NULL when some substitution has no codon to act on.
    """
    weights = spectrum or {s: 1 / 12 for s in SUBSTITUTIONS}
    rate = F.create_map(*[x for s in SUBSTITUTIONS for x in (F.lit(s), F.lit(float(weights[s])))])
    w = F.col("bases") * F.col("share")
    per_sub = (
        usage.join(table.where("bases > 0"), "codon")
        .groupBy(*by, "sub")
        .agg((F.sum(w * F.col("p_nonsyn")) / F.sum(w)).alias("p"))
        .withColumn("rate", F.element_at(rate, F.col("sub")))
    )
    total = F.sum(F.col("rate") * F.col("p"))
    whole = F.count(F.lit(1)) == len(SUBSTITUTIONS)
    return per_sub.groupBy(*by).agg(F.when(whole, total).alias("p_n"))


def observed_ns(annotated: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Nonsynonymous and synonymous letters of ``type``, their share and its 95 % Wilson interval."""
    n = F.length("type") - F.length(F.regexp_replace("type", "N", ""))
    s = F.length("type") - F.length(F.regexp_replace("type", "S", ""))
    sums = annotated.groupBy(*by).agg(F.sum(n).alias("n_nonsyn"), F.sum(s).alias("n_syn"))
    total = F.col("n_nonsyn") + F.col("n_syn")
    p = F.when(total > 0, F.col("n_nonsyn") / total)
    z = 1.959963984540054  # fixed value: 97.5 % normal quantile
    mid = (p + z * z / (2 * total)) / (1 + z * z / total)
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total)
    return sums.select(
        *by, "n_nonsyn", "n_syn", p.alias("p_obs"),
        F.when(total > 0, mid - half).alias("ci_low"), F.when(total > 0, mid + half).alias("ci_high"),
    )


def ns_binomial(observed: DataFrame, expected: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """One-sided binomial tests for an excess of N and of S against the expected share."""
    rows = observed.join(expected, list(by)) if by else observed.withColumn("p_n", expected.select("p_n").scalar())
    total = F.col("n_nonsyn") + F.col("n_syn")
    return rows.withColumn("p_excess_n", tails.binom_ge(F.col("n_nonsyn"), total, F.col("p_n"))).withColumn(
        "p_excess_s", tails.binom_ge(F.col("n_syn"), total, 1 - F.col("p_n"))
    )


def drop_leading_adjacent(muts: DataFrame, *, on: Sequence[str] = ("contig",)) -> DataFrame:
    """Drop sites directly followed by another site: an equi-join on the next position instead of a window."""
    nxt = muts.select(*on, (F.col("p") - 1).alias("p")).distinct()
    return muts.join(nxt, [*on, "p"], "left_anti")


def gene_tally(
    muts: DataFrame, *, min_count: int = 2, min_density: float = 0.001, keys: Sequence[str] = ("gene",), length: str = "gene_len"
) -> DataFrame:
    """Mutational events, N, S, length and density per gene; ``candidate`` marks genes over both thresholds.

    muts carries ``events`` and ``nonsyn`` (how many of its alleles are nonsynonymous) and ``alleles``.
    """
    t = muts.groupBy(*keys).agg(
        F.sum("events").alias("n_events"),
        F.sum("nonsyn").alias("n_nonsyn"),
        F.sum(F.col("alleles") - F.col("nonsyn")).alias("n_syn"),
        F.max(length).alias("len"),
    )
    t = t.withColumn("density", F.col("n_events") / F.col("len"))
    return t.withColumn("candidate", (F.col("n_events") >= min_count) & (F.col("density") >= min_density))


def gene_tail_p(tally: DataFrame, *, total: Column, callable_median: Column, coding_length: Column, n_genes: Column) -> DataFrame:
    """Poisson and binomial upper tails per candidate gene with the Bonferroni threshold.

    ``p_ge`` uses the rate over the callable genome and P(X >= n); ``p_gt`` and ``p_gt_binom`` the rate per coding
    base and P(X > n).
    """
    # Totals are columns before the tails use them: a higher-order function may hold no subquery.
    rows = tally.where("candidate").withColumns({
        "lambda": (total * F.col("len") / callable_median).cast("double"),
        "_rate": (tally.agg(F.sum("n_events")).scalar() / coding_length).cast("double"),
        "threshold": F.lit(0.05) / n_genes,
    })
    n = F.col("n_events")
    return rows.select(
        *[c for c in tally.columns if c != "candidate"],
        "lambda",
        tails.poisson_ge(n, F.col("lambda")).alias("p_ge"),
        tails.poisson_ge(n + 1, F.col("len") * F.col("_rate")).alias("p_gt"),
        tails.binom_ge(n + 1, F.col("len"), F.col("_rate")).alias("p_gt_binom"),
        "threshold",
    )


def combined_gene_counts(snvs: DataFrame, indels: DataFrame) -> DataFrame:
    """SNV events and exploded indel events per gene with the first name and product.

    snvs: gene, p, events, name, product. indels: genes (array), p, alts (array), name, product.
    """
    more = indels.select(
        F.explode("genes").alias("gene"), "p", F.size("alts").cast("long").alias("events"), "name", "product"
    )
    first = F.min_by(F.struct("name", "product"), F.struct("p", "name", "product"))
    rows = snvs.select("gene", "p", F.col("events").cast("long").alias("events"), "name", "product").unionByName(more)
    return rows.where(F.col("gene").isNotNull()).groupBy("gene").agg(
        F.sum("events").alias("n_events"), first.alias("f")
    ).select("gene", "n_events", F.col("f.name").alias("name"), F.col("f.product").alias("product"))


def dnds_percentile(genes: DataFrame) -> DataFrame:
    """dN/dS per gene, infinite values removed, its rank percentile (0..100) and logarithm.

    genes: gene, n_nonsyn, n_syn, p_n, support. Genes without synonymous changes have no finite ratio. Ranks come
    from the tiled histogram of ratios; equal ratios share the lowest rank. The log of a zero ratio takes the
    smallest finite log.
    """
    muts = F.col("n_nonsyn") + F.col("n_syn")
    rows = genes.where(muts > 0).where("n_syn > 0").withColumn("dn", F.col("n_nonsyn") / (muts * F.col("p_n"))).withColumn(
        "ds", F.col("n_syn") / (muts * (1 - F.col("p_n")))
    )
    rows = rows.withColumn("dnds", F.col("dn") / F.col("ds")).where(F.col("dnds").isNotNull())
    ranks = value_ranks(rows, keys=[], value="dnds", tile=value_tiles(rows, "dnds", 16))
    last = rows.agg(F.count(F.lit(1)) - 1).scalar()
    floor = rows.where("dnds > 0").agg(F.min(F.log("dnds"))).scalar()
    return rows.join(ranks.select("dnds", "below"), "dnds").select(
        "gene", "dn", "ds", "dnds",
        F.when(last > 0, F.col("below") / last * 100).otherwise(F.lit(0.0)).alias("percentile"),
        F.when(F.col("dnds") > 0, F.log("dnds")).otherwise(floor).alias("log_dnds"),
        "support",
    )


def spectrum_chi2(
    counts: DataFrame, background: DataFrame, *, keys: Sequence[str], min_mutations: int = 5, alpha: float = 0.05
) -> DataFrame:
    """2 x k contingency test of class counts against the background; Yates correction with one degree of freedom.

    counts: keys, cls, n. background: cls, n (every class of interest, possibly 0).
    """
    keys = list(keys)
    # Keys with every class: the class list is a fixed handful, carried as one array column.
    classes = background.agg(F.sort_array(F.collect_list(F.struct("cls", F.col("n").alias("bn"))))).scalar()
    grid = counts.select(*keys).distinct().withColumn("c", F.explode(classes)).select(*keys, "c.cls", "c.bn")
    full = grid.join(counts, [*keys, "cls"], "left").fillna(0, ["n"])
    totals = full.groupBy(*keys).agg(F.sum("n").alias("row1"), F.sum("bn").alias("row2"), F.count(F.lit(1)).alias("k"))
    cell = full.join(totals, keys)
    both = F.col("n") + F.col("bn")
    n_all = F.col("row1") + F.col("row2")

    def part(seen: Column, row: Column) -> Column:
        expect = row * both / n_all
        gap = F.abs(seen - expect)
        yates = F.when(F.col("k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.when(expect > 0, yates * yates / expect).otherwise(0.0)

    stat = F.sum(part(F.col("n"), F.col("row1")) + part(F.col("bn"), F.col("row2")))
    out = cell.groupBy(*keys).agg(stat.alias("chi2"), (F.max("k") - 1).alias("df"), F.max("row1").alias("n_mutations"))
    out = out.withColumn("p_value", tails.chi2_sf(F.col("chi2"), F.col("df")))
    return out.withColumn("flagged", (F.col("n_mutations") >= min_mutations) & (F.col("p_value") <= alpha))


def mean_called_share(wide: DataFrame, *, sample_columns: Sequence[str], missing: str = "?", gene: str = "locustag") -> DataFrame:
    """Mean share of called samples per gene from a wide site table; sites between genes (``;``) are dropped."""
    called = sum((F.when(F.col(c) != missing, 1).otherwise(0) for c in sample_columns), F.lit(0))
    return (
        wide.where(~F.col(gene).contains(";"))
        .groupBy(gene)
        .agg(F.avg(called / len(sample_columns)).alias("support"), F.count(F.lit(1)).alias("n_sites"))
    )
