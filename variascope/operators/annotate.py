"""Gene annotation of positions, substitutions, indels and regions.

Positions are 0-based and intervals half open: gene = [start, end) on its contig. ``seq`` is the coding-strand
sequence of a gene. Gene tables are annotation-sized; positions may be any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variascope.functions.bases import BASES, amino, complement, nt, nt_index, revcomp, translate
from variascope.plans.intervals import interval_join, last_at_or_before, overlap_join


def pos_to_contig(points: DataFrame, contigs: DataFrame, *, width: int = 4096) -> DataFrame:
    """Global offset to contig and offset inside it; positions outside every contig are dropped."""
    spans = contigs.select("contig", "start", (F.col("start") + F.col("len")).alias("end"))
    return interval_join(points, spans, point="p", start="start", end="end", width=width).select(
        *points.columns, "contig", (F.col("p") - F.col("start")).alias("pos")
    )


def contig_to_pos(points: DataFrame, contigs: DataFrame) -> DataFrame:
    """Contig offset to global offset; offsets beyond the contig are dropped."""
    return (
        points.join(contigs.select("contig", "start", "len"), "contig")
        .where((F.col("pos") >= 0) & (F.col("pos") < F.col("len")))
        .withColumn("p", F.col("start") + F.col("pos"))
        .drop("start", "len")
    )


def number_genes(genes: DataFrame, *, on=()) -> DataFrame:
    """1-based gene number in start order per contig, and the gene ending last so far (for gaps after nested genes)."""
    along = (Window.partitionBy(*on) if on else Window.partitionBy(F.lit(1))).orderBy("start", "end", "gene")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    return genes.withColumn("gene_num", F.row_number().over(along)).withColumn(
        "_last",
        F.max(
            F.struct(
                "end", (F.col("type") == "CDS").alias("cds"), (F.col("end") - F.col("start")).alias("len"),
                (-F.col("gene_num")).alias("neg"),
            )
        ).over(so_far),
    )


def _gap_anchor(numbered: DataFrame, on) -> DataFrame:
    return numbered.groupBy(*on, F.col("start").alias("_anchor")).agg(
        F.max("gene_num").alias("_k"), F.max("_last").alias("_last")
    )


def site_to_genes(
    sites: DataFrame, genes: DataFrame, *, on=(), width: int = 4096
) -> DataFrame:
    """Every gene over a position, else one row with ``gene_num`` = k + 0.5 after the k-th gene."""
    numbered = number_genes(genes, on=on)
    cols = [c for c in genes.columns if c not in on]
    hits = interval_join(
        sites, numbered.drop("_last"), point="p", start="start", end="end", on=on, width=width, how="left"
    )
    inside = hits.where(F.col("gene_num").isNotNull()).withColumn("gene_num", F.col("gene_num").cast("double"))
    outside = hits.where(F.col("gene_num").isNull()).select(*sites.columns)
    gaps = last_at_or_before(
        outside, _gap_anchor(numbered, on), point="p", anchor="_anchor", on=on, width=width
    )
    empty = [F.lit(None).cast(genes.schema[c].dataType).alias(c) for c in cols]
    return inside.select(*sites.columns, *cols, "gene_num").unionByName(
        gaps.select(*sites.columns, *empty, (F.coalesce("_k", F.lit(0)) + 0.5).cast("double").alias("gene_num"))
    )


def site_to_one_gene(
    sites: DataFrame, genes: DataFrame, *, on=(), width: int = 4096
) -> DataFrame:
    """One gene number per position: coding first, then the longest, then the first; a gap is numbered after the gene
    that covered its left neighbour (so a gap after a nested gene belongs to the enclosing gene)."""
    numbered = number_genes(genes, on=on)
    hits = interval_join(
        sites, numbered.select(*on, "start", "end", "type", "gene_num"), point="p", start="start", end="end",
        on=on, width=width, how="left",
    )
    chosen = hits.groupBy(*sites.columns).agg(
        F.max(
            F.when(
                F.col("gene_num").isNotNull(),
                F.struct(
                    (F.col("type") == "CDS").alias("cds"), (F.col("end") - F.col("start")).alias("len"),
                    (-F.col("gene_num")).alias("neg"),
                ),
            )
        ).alias("_best")
    )
    gaps = last_at_or_before(
        chosen.where(F.col("_best").isNull()).drop("_best"), _gap_anchor(numbered, on), point="p", anchor="_anchor",
        on=on, width=width,
    )
    return (
        chosen.where(F.col("_best").isNotNull())
        .select(*sites.columns, (-F.col("_best.neg")).cast("double").alias("gene_num"))
        .unionByName(
            gaps.select(*sites.columns, (F.coalesce(-F.col("_last.neg"), F.lit(0)) + 0.5).cast("double").alias("gene_num"))
        )
    )


def promoter_or_intergenic(
    sites: DataFrame, genes: DataFrame, *, on=(), promoter: int = 250, width: int = 4096
) -> DataFrame:
    """Intergenic positions with their neighbours, signed distances and class P or I.

    A distance is negative when the position lies upstream of the neighbour.
    """
    numbered = number_genes(genes, on=on).select(*on, "gene", "start", "end", "strand", "gene_num")
    along = (Window.partitionBy(*on) if on else Window.partitionBy(F.lit(1))).orderBy("gene_num")
    nxt = F.lead(F.struct("gene", "start", "strand")).over(along)
    anchors = numbered.withColumn("_n", nxt).groupBy(*on, F.col("start").alias("_anchor")).agg(
        F.max_by(F.struct("gene", "end", "strand", "_n"), "gene_num").alias("_g")
    )
    first = numbered.groupBy(*on).agg(F.min_by(F.struct("gene", "start", "strand"), "gene_num").alias("_first"))
    free = interval_join(
        sites, genes, point="p", start="start", end="end", on=on, width=width, how="left_anti"
    )
    rows = last_at_or_before(free, anchors, point="p", anchor="_anchor", on=on, width=width)
    if on:
        rows = rows.join(first, list(on), "left")
    else:
        rows = rows.withColumn("_first", first.select("_first").scalar())
    before = F.col("_g")
    after = F.when(before.isNull(), F.col("_first")).otherwise(F.col("_g._n"))
    d1 = (F.col("p") + 1 - before["end"]) * F.when(before["strand"] == -1, -1).otherwise(1)
    d2 = (after["start"] - F.col("p")) * F.when(after["strand"] == 1, -1).otherwise(1)
    near = ((d1 > -promoter) & (d1 < 0)) | ((d2 > -promoter) & (d2 < 0))
    return rows.select(
        *sites.columns,
        before["gene"].alias("gene1"),
        d1.cast("long").alias("distance1"),
        after["gene"].alias("gene2"),
        d2.cast("long").alias("distance2"),
        F.when(F.coalesce(((d1 > -promoter) & (d1 < 0)), F.lit(False)) | F.coalesce(((d2 > -promoter) & (d2 < 0)), F.lit(False)), "P")
        .otherwise("I")
        .alias("type"),
    )


def ordered_alternates(mutated: DataFrame, *, on=()) -> DataFrame:
    """Distinct alternate calls per site in order of the first sample that carries them (at most four)."""
    first = mutated.groupBy(*on, "p", "call").agg(F.min("sample").alias("s"))
    return first.groupBy(*on, "p").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("s", "call"))), lambda x: x["call"]).alias("alts")
    )


def annotate_snv(
    sites: DataFrame, genes: DataFrame, *, on=(), promoter: int = 250, width: int = 4096
) -> DataFrame:
    """One row per (site, overlapping gene), or one intergenic row per site.

    sites: on, p, ref, anc (0..3 or NULL), alts (array of calls). genes: on, gene, start, end, strand, type, seq.
    Types per alternate: N or S in coding genes, U without a full codon, R in other genes; P or I outside genes.
    """
    # Sequences stay out of the interval join: a hit later meets only the short piece that holds its codon.
    hits = interval_join(sites, genes.drop("seq"), point="p", start="start", end="end", on=on, width=width)
    plus = F.col("strand") == 1
    nt_pos = F.when(plus, F.col("p") - F.col("start") + 1).otherwise(F.col("end") - F.col("p")).cast("int")
    rows = hits.withColumn("nt_pos", nt_pos)
    aa_pos = F.floor((F.col("nt_pos") - 1) / 3).cast("int") + 1
    rows = rows.withColumn("aa_pos", aa_pos).withColumn("_ncn", F.col("nt_pos") - (F.col("aa_pos") - 1) * 3)
    size = 33
    pieces = genes.where("type = 'CDS'").select(
        *on, "gene", F.posexplode(F.regexp_extract_all(F.col("seq"), F.lit(f"(?s)(.{{1,{3 * size}}})"), F.lit(1))).alias("_k", "_piece")
    )
    rows = rows.withColumn("_k", F.floor((F.col("aa_pos") - 1) / size).cast("int")).join(pieces, [*on, "gene", "_k"], "left")
    at = (F.col("aa_pos") - 1) % size * 3 + 1
    rows = rows.withColumn("_codon", F.substring(F.col("_piece"), at, F.lit(3)))
    coding = F.col("type") == "CDS"
    codon = F.col("_codon")
    full = coding & (F.length(codon) == 3) & F.col("ref").isNotNull()

    def variant(base: Column) -> Column:
        letter = F.when(plus, base).otherwise(complement(base))
        return F.concat(
            F.substring(codon, F.lit(1), F.col("_ncn") - 1), letter, F.substring(codon, F.col("_ncn") + 1, F.lit(3))
        )

    rows = rows.withColumn(
        "codons", F.when(F.coalesce(full, F.lit(False)), F.array(*[variant(F.lit(x)) for x in BASES])).otherwise(F.array().cast("array<string>"))
    )
    rows = rows.withColumn("aa", F.transform("codons", amino))
    ref_aa = F.get("aa", F.col("ref"))
    rows = rows.withColumn("aa_ref", F.when(full, ref_aa)).withColumn("aa_anc", F.when(full, F.get("aa", F.col("anc"))))
    alt_aa = F.transform("alts", lambda a: F.get(F.col("aa"), a))
    rows = rows.withColumn("aa_alt", F.when(full, alt_aa))
    # With no known ancestor every alternate counts as nonsynonymous relative to it.
    inside = rows.select(
        *sites.columns,
        "gene",
        "strand",
        "nt_pos",
        F.when(coding, F.col("aa_pos")).alias("aa_pos"),
        "codons",
        "aa",
        F.when(full, F.array_join(F.transform("aa_alt", lambda x: F.when(x == F.col("aa_ref"), "S").otherwise("N")), ""))
        .when(coding, "U")
        .otherwise("R")
        .alias("type"),
        F.when(
            full,
            F.transform("aa_alt", lambda x: F.when(x != F.col("aa_ref"), F.concat("aa_ref", F.col("aa_pos"), x)).otherwise(".")),
        )
        .otherwise(F.array(F.lit(".")))
        .alias("muts"),
        F.when(full, F.transform("aa_alt", lambda x: x != F.col("aa_ref"))).alias("nonsyn_rel_ref"),
        F.when(full, F.transform("aa_alt", lambda x: F.coalesce(x != F.col("aa_anc"), F.lit(True)))).alias("nonsyn_rel_anc"),
    )
    outside = promoter_or_intergenic(sites, genes.drop("seq"), on=on, promoter=promoter, width=width)
    blank = {f.name: f.dataType for f in inside.schema.fields}
    fill = [
        F.lit(None).cast(blank[c]).alias(c)
        for c in ("gene", "strand", "nt_pos", "aa_pos", "codons", "aa", "muts", "nonsyn_rel_ref", "nonsyn_rel_anc")
    ]
    return inside.unionByName(outside.select(*sites.columns, "type", *fill)).withColumn(
        "nt_ref", nt(F.col("ref"))
    ).withColumn("nt_alt", F.array_join(F.transform("alts", nt), ""))


# Mutation types from highest to lowest priority.
TYPE_ORDER = "NSRPIU"


def dedup_annotation(annotated: DataFrame, *, on=()) -> DataFrame:
    """Rank overlapping gene rows per (site, allele): ``rank`` 1 is kept, larger ranks are the rejected rows.

    Rows with fewer typed alleles than the best row of the site lose entirely (rank 0). Among the rest the order is
    N, S, R, P, I, U; premature stops first among N; then the first gene. A site has few gene rows, so the window
    partitions are tiny.
    """
    site = Window.partitionBy(*on, "p")
    rows = annotated.withColumn("_n", F.length("type")).withColumn("_max", F.max("_n").over(site))
    alleles = rows.select(
        *on, "p", "gene", "_n", "_max", "muts", "nt_alt", F.posexplode(F.split("type", "")).alias("allele", "atype")
    ).where(F.col("atype") != "")
    mut = F.get("muts", F.col("allele"))
    prio = F.call_function("instr", F.lit(TYPE_ORDER), F.col("atype"))
    stop = F.when((F.col("atype") == "N") & F.coalesce(mut.endswith("*"), F.lit(False)), 0).otherwise(1)
    order = Window.partitionBy(*on, "p", "allele", F.col("_n") == F.col("_max")).orderBy(prio, stop, "gene")
    return alleles.withColumn("mut", mut).withColumn(
        "rank", F.when(F.col("_n") == F.col("_max"), F.row_number().over(order)).otherwise(F.lit(0))
    ).select(*on, "p", "gene", "allele", F.col("atype").alias("type"), "mut", "rank")


def repolarize(annotated: DataFrame) -> DataFrame:
    """Swap the alternate where the ancestor differs from the reference; recompute labels and types from ``aa``.

    Rows with an unknown ancestor are not allowed (the whole table would be ambiguous): they yield NULL labels.
    """
    swap = F.col("anc") != F.col("ref")
    alts = F.transform("alts", lambda a: F.when(a == F.col("anc"), F.col("ref")).otherwise(a))
    rows = annotated.withColumn("_alts", F.when(swap, alts).otherwise(F.col("alts")))
    has_aa = F.size("aa") == 4
    anc_aa = F.get("aa", F.col("anc"))
    rows = rows.withColumn("_anc_aa", anc_aa).withColumn("_alt_aa", F.transform("_alts", lambda a: F.get(F.col("aa"), a)))
    muts = F.transform(
        "_alt_aa", lambda x: F.when(x != F.col("_anc_aa"), F.concat("_anc_aa", F.col("aa_pos"), x)).otherwise(".")
    )
    redo = swap & has_aa
    rows = rows.withColumn("_muts", F.when(redo, muts).otherwise(F.col("muts")))
    return rows.select(
        *[c for c in annotated.columns if c not in ("alts", "muts", "type", "nt_alt")],
        F.col("_alts").alias("alts"),
        F.col("_muts").alias("muts"),
        F.when(redo, F.array_join(F.transform("_muts", lambda m: F.when(m == ".", "S").otherwise("N")), ""))
        .otherwise(F.col("type"))
        .alias("type"),
        F.array_join(F.transform("_alts", nt), "").alias("nt_alt"),
    )


def annotate_indel(
    indels: DataFrame, genes: DataFrame, *, on=(), promoter: int = 250, width: int = 4096
) -> DataFrame:
    """Effect of each (site, reference string, alternate string) on every overlapped gene; P or I elsewhere.

    indels: on, p, ref, alt, n_samples. genes additionally carry ``translation``.
    """
    spans = indels.withColumn("_stop", F.col("p") + F.length("ref"))
    hits = overlap_join(
        spans, genes, a_start="p", a_end="_stop", b_start="start", b_end="end", on=on, width=width
    )
    plus = F.col("strand") == 1
    size = F.length("ref")
    begin = F.when(plus, F.col("p") - F.col("start") + 1).otherwise(F.col("end") - F.col("p") - size).cast("int")
    rows = hits.withColumn("indel_start", begin).withColumn("indel_end", F.col("indel_start") + size)
    alt = F.when(plus, F.col("alt")).otherwise(revcomp(F.col("alt")))
    length = (F.col("end") - F.col("start") - 1).cast("int")
    head = F.substring(F.col("seq"), F.lit(1), F.col("indel_start"))
    tail = F.substring(F.col("seq"), F.col("indel_end") + 1, F.length("seq"))
    new_start = F.concat(alt, tail)
    at = F.instr(new_start, "ATG")
    restarted = F.when(at > 0, F.substring(new_start, at, F.length(new_start))).otherwise(
        F.substring(new_start, F.length(new_start), F.lit(1))
    )
    spliced = (
        F.when(F.col("indel_start") < 0, restarted)
        .when(F.col("indel_end") > length, F.concat(head, alt))
        .otherwise(F.concat(head, alt, tail))
    )
    rows = rows.withColumn("alt_seq", spliced)
    rows = rows.withColumn("frameshift", F.length("alt_seq") % 3).withColumn("alt_protein", translate(F.col("alt_seq")))
    stop = F.instr("alt_protein", "*")
    own = F.length("translation")
    inside = rows.select(
        *indels.columns,
        "gene",
        F.lit("G").alias("type"),
        "indel_start",
        "indel_end",
        "frameshift",
        "alt_protein",
        (F.col("alt_protein") != F.col("translation")).alias("changed"),
        F.when(stop == 0, "extended+").when(stop > own, "extended").when(stop == own, "same").otherwise("truncated").alias("stop_class"),
        F.when(stop == 0, F.length("alt_protein") + 1).otherwise(stop).alias("stop_pos"),
    )
    keys = [*on, "p", "ref", "alt"]
    free = indels.join(inside.select(*keys), keys, "left_anti")
    outside = promoter_or_intergenic(free, genes, on=on, promoter=promoter, width=width)
    blank = {f.name: f.dataType for f in inside.schema.fields}
    fill = [
        F.lit(None).cast(blank[c]).alias(c)
        for c in ("gene", "indel_start", "indel_end", "frameshift", "alt_protein", "changed", "stop_class", "stop_pos")
    ]
    return inside.unionByName(outside.select(*indels.columns, "type", *fill))


def attach_orthologs(genes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster tag whose comma list of members contains the gene's locus tag."""
    members = clusters.select("tag", F.explode(F.split("members", ",")).alias("locustag")).withColumn(
        "locustag", F.trim("locustag")
    )
    return genes.join(members, "locustag", "left")


def find_gene(genes: DataFrame, contigs: DataFrame, text: str, *, edge: int = 0) -> DataFrame:
    """Case-insensitive search in the attribute text, with flags for genes at a contig edge."""
    return (
        genes.where(F.lower("attributes").contains(text.lower()))
        .join(contigs.select("contig", "len"), "contig")
        .withColumn("at_contig_start", F.col("start") <= edge)
        .withColumn("at_contig_end", F.col("end") >= F.col("len") - edge)
    )


def reference_chunks(contigs: DataFrame, *, width: int = 1000) -> DataFrame:
    """(contig, k, piece): the sequence in pieces of ``width`` bases, cut in one linear pass.

    Taking a base out of a whole contig walks the contig for every base; a piece is short and joins by equality.
    """
    pieces = F.regexp_extract_all(F.col("seq"), F.lit(f"(?s)(.{{1,{width}}})"), F.lit(1))
    return contigs.select("contig", F.posexplode(pieces).alias("k", "piece"))


def extract_gene_seq(genes: DataFrame, contigs: DataFrame, *, width: int = 1000) -> DataFrame:
    """Coding-strand sequence of each gene, put together from the reference pieces it touches."""
    keys = ["contig", "start", "end", "strand"]
    places = genes.select(*keys).distinct()
    spans = places.withColumn(
        "k", F.explode(F.sequence(F.floor(F.col("start") / width).cast("int"), F.floor((F.col("end") - 1) / width).cast("int")))
    )
    joined = spans.join(reference_chunks(contigs, width=width), ["contig", "k"]).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda s: s["piece"]), "").alias("_t")
    )
    piece = F.substring(
        F.col("_t"), (F.col("start") % width + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")
    )
    cut = joined.select(*keys, F.when(F.col("strand") == -1, revcomp(piece)).otherwise(piece).alias("seq"))
    rows = genes.drop("seq") if "seq" in genes.columns else genes
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    cond = same[0] & same[1] & same[2] & same[3]
    return rows.alias("g").join(cut.alias("s"), cond).select("g.*", "s.seq")


def ref_base_at(points: DataFrame, contigs: DataFrame, *, width: int = 1000) -> DataFrame:
    """Reference base and its call index at (contig, pos)."""
    base = F.upper(F.substring(F.col("piece"), (F.col("pos") % width + 1).cast("int"), F.lit(1)))
    keyed = points.withColumn("k", F.floor(F.col("pos") / width).cast("int"))
    return keyed.join(reference_chunks(contigs, width=width), ["contig", "k"]).select(
        *points.columns, base.alias("base"), nt_index(base).alias("ref")
    )


def short_locus(gene: Column, locustag: Column, prefix: str) -> Column:
    """Gene names of a ``;`` list; a missing name (``.``) becomes LT plus the shortened locus tag."""
    genes, tags = F.split(gene, ";"), F.split(locustag, ";")
    return F.array_join(
        F.transform(
            genes,
            lambda g, i: F.when(
                g == ".",
                F.concat(F.lit("LT"), F.regexp_replace(F.replace(F.element_at(F.split(F.get(tags, i), ":"), -1), F.lit(prefix), F.lit("")), "_", "")),
            ).otherwise(g),
        ),
        ";",
    )


def neighbour_text(gene: Column, gene1: Column, d1: Column, gene2: Column, d2: Column) -> Column:
    """Text of a site's surroundings: the gene, else the neighbours with their distances."""
    left = F.when(gene1.isNotNull(), F.concat(gene1, F.lit("("), d1, F.lit(")")))
    right = F.when(gene2.isNotNull(), F.concat(gene2, F.lit("("), d2, F.lit(")")))
    return F.coalesce(gene, F.concat_ws(" / ", left, right))


def isolate_genotype(calls: DataFrame) -> DataFrame:
    """Ordered derived mutations per isolate. calls: isolate, kind (0 SNV, 1 indel), ord, label, call, anc, ref."""
    derived = calls.where(F.col("call").isNotNull() & (F.col("call") != F.coalesce("anc", "ref")))
    lists = derived.groupBy("isolate").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("kind", "ord", "label"))), lambda s: s["label"]), "; "
        ).alias("genotype")
    )
    return calls.select("isolate").distinct().join(lists, "isolate", "left").select(
        "isolate", F.coalesce("genotype", F.lit("ancestral")).alias("genotype")
    )


def genotype_frequency(genotypes: DataFrame) -> DataFrame:
    """Share of each genotype per time point: two aggregations and a join, so no window over a whole time point."""
    counts = genotypes.groupBy("time", "genotype").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("time").agg(F.sum("n").alias("total"))
    return counts.join(totals, "time").select("time", "genotype", "n", (F.col("n") / F.col("total")).alias("freq"))
