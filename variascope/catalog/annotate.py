"""Queries over gene annotation and recombination operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from variascope import bindings as b
from variascope.bindings import (
    SQL_CONTIG_CALLS,
    SQL_CONTIG_GENES,
    SQL_GENES,
    SQL_GENOME_SITES,
    SQL_INTERVALS,
    SQL_SEQUENCES,
    SQL_SITES,
)
from variascope.functions.bases import nt
from variascope.operators import annotate as a
from variascope.operators import recombination as rc
from variascope.plans.lineage import cut
from variascope.registry import query
from variascope.sources.fasta import contig_index

R = F.round


def doc_contigs(spark, sf):
    docs = b.table(spark, sf, "documents").select(
        F.col("doc_id").alias("contig_idx"), F.col("doc_id").alias("contig"), F.col("n_chars").alias("len")
    )
    return contig_index(docs)


SQL_CONTIGS = """contigs AS (SELECT doc_id AS contig, n_chars AS len,
  CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents)"""


@query(
    "an1_pos_to_contig",
    f"""WITH {SQL_GENOME_SITES}, {SQL_CONTIGS} SELECT p, contig, p - start AS pos FROM sites JOIN contigs ON p >= start AND p < start + len""",
)
def an1(spark, sf):
    return a.pos_to_contig(b.genome_sites(spark, sf), doc_contigs(spark, sf))


@query(
    "an1_contig_to_pos",
    f"""WITH {SQL_CONTIGS} SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS contig, l_orderkey % 5000 AS pos, start + l_orderkey % 5000 AS p
    FROM lineitem JOIN contigs ON contig = l_partkey WHERE l_orderkey % 5000 < len""",
)
def an1_back(spark, sf):
    points = b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("contig"), (F.col("l_orderkey") % 5000).alias("pos")
    )
    return a.contig_to_pos(points, doc_contigs(spark, sf))


@query(
    "an2_site_to_genes",
    f"""WITH {SQL_SITES}, {SQL_GENES}, num AS (SELECT *, row_number() OVER (ORDER BY start) AS k FROM genes),
    hit AS (SELECT p, gene, k FROM sites JOIN num ON p >= start AND p < "end")
    SELECT p, gene, CAST(k AS DOUBLE) AS gene_num FROM hit UNION ALL
    SELECT p, NULL, (SELECT count(*) FROM genes WHERE start <= p) + 0.5::DOUBLE FROM sites WHERE p NOT IN (SELECT p FROM hit)""",
)
def an2(spark, sf):
    genes = b.genes(spark, sf)
    return a.site_to_genes(b.sites(spark, sf), genes, width=512).select("p", "gene", "gene_num")


@query(
    "an3_site_to_one_gene",
    f"""WITH {SQL_SITES}, {SQL_GENES}, num AS (SELECT *, row_number() OVER (ORDER BY start) AS k FROM genes),
    hit AS (SELECT p, k, row_number() OVER (PARTITION BY p ORDER BY type = 'CDS' DESC, "end" - start DESC, k) AS rk FROM sites JOIN num ON p >= start AND p < "end"),
    gap AS (SELECT p, (SELECT max("end") FROM num WHERE start <= p) - 1 AS left_base FROM sites WHERE p NOT IN (SELECT p FROM hit)),
    lefts AS (SELECT p, k, row_number() OVER (PARTITION BY p ORDER BY type = 'CDS' DESC, "end" - start DESC, k) AS rk
      FROM gap LEFT JOIN num ON left_base >= start AND left_base < "end")
    SELECT p, CAST(k AS DOUBLE) AS gene_num FROM hit WHERE rk = 1 UNION ALL
    SELECT p, coalesce(k, 0) + 0.5::DOUBLE FROM lefts WHERE rk = 1""",
)
def an3(spark, sf):
    return a.site_to_one_gene(b.sites(spark, sf), b.genes(spark, sf), width=512)


@query(
    "an5_promoter_or_intergenic",
    f"""WITH {SQL_SITES}, {SQL_GENES}, free AS (SELECT p FROM sites WHERE NOT EXISTS (SELECT 1 FROM genes WHERE p >= start AND p < "end")),
    prev AS (SELECT p, gene AS gene1, (p + 1 - "end") * CASE WHEN strand = -1 THEN -1 ELSE 1 END AS distance1 FROM free ASOF LEFT JOIN genes ON p >= start),
    nxt AS (SELECT p, gene AS gene2, (start - p) * CASE WHEN strand = 1 THEN -1 ELSE 1 END AS distance2 FROM free ASOF LEFT JOIN genes ON p < start)
    SELECT prev.p, gene1, distance1, gene2, distance2, CASE WHEN (distance1 > -50 AND distance1 < 0) OR (distance2 > -50 AND distance2 < 0) THEN 'P' ELSE 'I' END AS type
    FROM prev JOIN nxt ON nxt.p = prev.p""",
)
def an5(spark, sf):
    return a.promoter_or_intergenic(b.sites(spark, sf), b.genes(spark, sf), promoter=50, width=512)


def contig_sites(spark, sf, docs):
    mutated = b.contig_calls(spark, sf, docs).where(F.col("call") != F.col("ref"))
    anc = F.when(F.col("p") % 7 != 0, (F.col("p") % 4).cast("int"))
    return a.ordered_alternates(mutated, on=["contig", "ref"]).withColumn("anc", anc)


def annotated(spark, sf):
    # Contig sequences feed the calls and the genes: derived once and stored, like the reference they stand for.
    docs = cut(b.sequences(spark, sf))
    return a.annotate_snv(
        contig_sites(spark, sf, docs), b.contig_genes(spark, sf, docs), on=["contig"], promoter=60, width=2048
    )


# Codon and amino acid of every call, spelled independently of the operator.
SQL_ANNOTATED = f"""{SQL_CONTIG_GENES}, {SQL_CONTIG_CALLS},
mut AS (SELECT contig, p, ref, call, min(sample) AS s FROM cc WHERE call <> ref GROUP BY 1, 2, 3, 4),
hit AS (SELECT m.contig, m.p, m.ref, m.call, m.s, g.gene, g.strand, g.type, g.seq,
   CASE WHEN strand = 1 THEN m.p - start + 1 ELSE "end" - m.p END AS nt_pos FROM mut m JOIN cg g ON g.contig = m.contig AND m.p >= start AND m.p < "end"),
cod AS (SELECT *, (nt_pos - 1) // 3 + 1 AS aa_pos, substr(seq, (nt_pos - 1) // 3 * 3 + 1, 3) AS codon, (nt_pos - 1) % 3 + 1 AS ncn,
   CASE WHEN p % 7 <> 0 THEN CAST(p % 4 AS INTEGER) END AS anc FROM hit),
var AS (SELECT *, length(seq) >= aa_pos * 3 AS whole,
   substr(codon, 1, ncn - 1) || substr(CASE WHEN strand = 1 THEN 'ATCG' ELSE 'TAGC' END, ref + 1, 1) || substr(codon, ncn + 1) AS cref,
   substr(codon, 1, ncn - 1) || substr(CASE WHEN strand = 1 THEN 'ATCG' ELSE 'TAGC' END, anc + 1, 1) || substr(codon, ncn + 1) AS canc,
   substr(codon, 1, ncn - 1) || substr(CASE WHEN strand = 1 THEN 'ATCG' ELSE 'TAGC' END, call + 1, 1) || substr(codon, ncn + 1) AS calt FROM cod),
code AS (SELECT substr('TCAG', CAST(i + 1 AS BIGINT), 1) || substr('TCAG', CAST(j + 1 AS BIGINT), 1) || substr('TCAG', CAST(k + 1 AS BIGINT), 1) AS codon,
   substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(16 * i + 4 * j + k + 1 AS BIGINT), 1) AS aa
   FROM range(4) x(i), range(4) y(j), range(4) z(k)),
aas AS (SELECT v.*, r.aa AS aref, n.aa AS aanc, t.aa AS aalt FROM var v LEFT JOIN code r ON r.codon = cref LEFT JOIN code n ON n.codon = canc LEFT JOIN code t ON t.codon = calt),
per AS (SELECT *, CASE WHEN type <> 'CDS' THEN 'R' WHEN NOT whole THEN 'U' WHEN aalt = aref THEN 'S' ELSE 'N' END AS mtype,
   CASE WHEN type = 'CDS' AND whole AND aalt <> aref THEN aref || aa_pos || aalt ELSE '.' END AS mlabel,
   CASE WHEN type = 'CDS' AND whole THEN coalesce(aalt <> aanc, TRUE) END AS nonsyn FROM aas),
ann AS (SELECT contig, p, gene, any_value(ref) AS ref, CASE WHEN any_value(type) = 'CDS' THEN any_value(aa_pos) END AS aa_pos,
   CASE WHEN any_value(type) = 'CDS' AND any_value(whole) THEN string_agg(mtype, '' ORDER BY s, call) ELSE any_value(mtype) END AS type,
   CASE WHEN any_value(type) = 'CDS' AND any_value(whole) THEN string_agg(mlabel, ',' ORDER BY s, call) ELSE '.' END AS muts,
   string_agg(CAST(nonsyn AS VARCHAR), ',' ORDER BY s, call) AS nonsyn, string_agg(substr('ATCG', call + 1, 1), '' ORDER BY s, call) AS nt_alt
   FROM per GROUP BY 1, 2, 3)"""


@query(
    "an4_annotate_snv",
    f"""WITH {SQL_ANNOTATED}, free AS (SELECT DISTINCT contig, p FROM mut m WHERE NOT EXISTS (SELECT 1 FROM cg WHERE cg.contig = m.contig AND m.p >= start AND m.p < "end")),
    d AS (SELECT f.contig, f.p, (f.p + 1 - l."end") * CASE WHEN l.strand = -1 THEN -1 ELSE 1 END AS d1, (r.start - f.p) * CASE WHEN r.strand = 1 THEN -1 ELSE 1 END AS d2
      FROM free f ASOF LEFT JOIN cg l ON l.contig = f.contig AND f.p >= l.start ASOF LEFT JOIN cg r ON r.contig = f.contig AND f.p < r.start),
    alts AS (SELECT contig, p, any_value(ref) AS ref, string_agg(substr('ATCG', call + 1, 1), '' ORDER BY s, call) AS nt_alt FROM mut GROUP BY 1, 2)
    SELECT contig, p, gene, CAST(aa_pos AS INTEGER) AS aa_pos, type, muts, nonsyn, substr('ATCG', ref + 1, 1) AS nt_ref, nt_alt FROM ann UNION ALL
    SELECT d.contig, d.p, NULL, NULL, CASE WHEN (d1 > -60 AND d1 < 0) OR (d2 > -60 AND d2 < 0) THEN 'P' ELSE 'I' END, NULL, NULL, substr('ATCG', ref + 1, 1), nt_alt
    FROM d JOIN alts x ON x.contig = d.contig AND x.p = d.p""",
)
def an4(spark, sf):
    return annotated(spark, sf).select(
        "contig", "p", "gene", "aa_pos", "type",
        F.array_join("muts", ",").alias("muts"),
        F.array_join(F.transform("nonsyn_rel_anc", lambda x: x.cast("string")), ",").alias("nonsyn"),
        "nt_ref", "nt_alt",
    )


@query(
    "an6_dedup_annotation",
    f"""WITH {SQL_ANNOTATED}, al AS (SELECT contig, p, gene, length(type) AS n, max(length(type)) OVER (PARTITION BY contig, p) AS mx,
      unnest(str_split(type, '')) AS t, generate_subscripts(str_split(type, ''), 1) - 1 AS allele, str_split(muts, ',') AS ms FROM ann),
    r AS (SELECT *, ms[allele + 1] AS mut, row_number() OVER (PARTITION BY contig, p, allele, n = mx ORDER BY instr('NSRPIU', t),
      CASE WHEN t = 'N' AND coalesce(ms[allele + 1], '') LIKE '%*' THEN 0 ELSE 1 END, gene) AS rk FROM al)
    SELECT contig, p, gene, CAST(allele AS INTEGER) AS allele, t AS type, mut, CASE WHEN n = mx THEN CAST(rk AS INTEGER) ELSE 0 END AS rank FROM r""",
)
def an6(spark, sf):
    inside = annotated(spark, sf).where(F.col("gene").isNotNull())
    return a.dedup_annotation(inside, on=["contig"])


@query(
    "an7_repolarize",
    f"""WITH {SQL_ANNOTATED}, k AS (SELECT *, CASE WHEN call = anc THEN ref ELSE call END AS alt2, CASE WHEN call = anc THEN aref ELSE aalt END AS aalt2 FROM per WHERE anc IS NOT NULL),
    o AS (SELECT *, anc <> ref AS sw, type = 'CDS' AND whole AS has FROM k),
    l AS (SELECT *, CASE WHEN sw AND has THEN CASE WHEN aalt2 <> aanc THEN aanc || aa_pos || aalt2 ELSE '.' END ELSE mlabel END AS lab FROM o)
    SELECT contig, p, gene, string_agg(substr('ATCG', CASE WHEN sw THEN alt2 ELSE call END + 1, 1), '' ORDER BY s, call) AS nt_alt,
      CASE WHEN any_value(has) THEN string_agg(CASE WHEN sw THEN CASE WHEN lab = '.' THEN 'S' ELSE 'N' END ELSE mtype END, '' ORDER BY s, call) ELSE any_value(mtype) END AS type,
      CASE WHEN any_value(has) THEN string_agg(lab, ',' ORDER BY s, call) ELSE '.' END AS muts FROM l GROUP BY 1, 2, 3""",
)
def an7(spark, sf):
    inside = annotated(spark, sf).where(F.col("gene").isNotNull() & F.col("anc").isNotNull())
    return a.repolarize(inside).select("contig", "p", "gene", "nt_alt", "type", F.array_join("muts", ",").alias("muts"))


def indels(spark, sf, docs):
    docs = docs.select(F.col("doc_id").alias("contig"), "seq").where(F.length("seq") > 8)
    li = b.table(spark, sf, "lineitem").join(docs, F.col("l_partkey") == F.col("contig"))
    p = F.col("l_orderkey") * 37 % F.length("seq")
    q = F.col("l_suppkey") * 13 % F.length("seq")
    rows = li.select(
        "contig", p.alias("p"), "l_suppkey",
        F.substring(F.col("seq"), (p + 1).cast("int"), F.col("l_linenumber") % 3 + 1).alias("ref"),
        F.substring(F.col("seq"), (q + 1).cast("int"), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("alt"),
    )
    return rows.groupBy("contig", "p", "ref", "alt").agg(F.countDistinct("l_suppkey").alias("n_samples"))


SQL_INDEL = f"""{SQL_CONTIG_GENES},
ind AS (SELECT contig, p, ref, alt, count(DISTINCT l_suppkey) AS n_samples FROM (
  SELECT l_partkey AS contig, l_suppkey, l_orderkey * 37 % length(seq) AS p, substr(seq, l_orderkey * 37 % length(seq) + 1, l_linenumber % 3 + 1) AS ref,
    substr(seq, l_suppkey * 13 % length(seq) + 1, l_suppkey % 4 + 1) AS alt FROM lineitem JOIN sequences ON doc_id = l_partkey WHERE length(seq) > 8) GROUP BY 1, 2, 3, 4),
h AS (SELECT i.*, g.gene, g.strand, g.seq, "end" - start - 1 AS glen, length(ref) AS rl,
  CASE WHEN strand = 1 THEN i.p - start + 1 ELSE "end" - i.p - length(ref) END AS s0,
  CASE WHEN strand = 1 THEN alt ELSE reverse(translate(alt, 'ATCG', 'TAGC')) END AS a
  FROM ind i JOIN cg g ON g.contig = i.contig AND i.p < "end" AND start < i.p + length(ref)),
sp AS (SELECT *, CASE WHEN s0 < 0 THEN CASE WHEN instr(a || substr(seq, s0 + rl + 1), 'ATG') > 0 THEN substr(a || substr(seq, s0 + rl + 1), instr(a || substr(seq, s0 + rl + 1), 'ATG'))
       ELSE right(a || substr(seq, s0 + rl + 1), 1) END
     WHEN s0 + rl > glen THEN substr(seq, 1, s0) || a ELSE substr(seq, 1, s0) || a || substr(seq, s0 + rl + 1) END AS x FROM h)"""


@query(
    "an8_annotate_indel",
    f"""WITH {SQL_INDEL} SELECT contig, p, ref, alt, n_samples, gene, CAST(s0 AS INTEGER) AS indel_start, CAST(s0 + rl AS INTEGER) AS indel_end,
    CAST(length(x) % 3 AS INTEGER) AS frameshift FROM sp""",
)
def an8(spark, sf):
    docs = cut(b.sequences(spark, sf))
    genes = cut(b.contig_genes(spark, sf, docs)).withColumn("translation", a.translate(F.col("seq")))
    out = a.annotate_indel(cut(indels(spark, sf, docs)), genes, on=["contig"], promoter=60, width=2048)
    return out.where("type = 'G'").select(
        "contig", "p", "ref", "alt", "n_samples", "gene", "indel_start", "indel_end", "frameshift"
    )


@query(
    "an9_genes_in_region",
    f"""WITH {SQL_GENES}, r AS (SELECT o_custkey AS region, min(o_orderkey) * 13 AS s, min(o_orderkey) * 13 + 900 AS e FROM orders GROUP BY 1)
    SELECT region, gene FROM r JOIN genes ON start >= s AND "end" <= e AND start < e""",
)
def an9(spark, sf):
    from variascope.operators.segments import genes_in_region

    regions = b.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("region")).agg(
        (F.min("o_orderkey") * 13).alias("start")
    ).withColumn("end", F.col("start") + 900)
    return genes_in_region(regions, b.genes(spark, sf), width=512).select("region", "gene")


@query(
    "an10_attach_orthologs",
    """WITH m AS (SELECT o_custkey AS tag, o_orderkey % 2000 AS locus FROM orders GROUP BY 1, 2)
    SELECT p_partkey AS gene, tag FROM part LEFT JOIN m ON locus = p_partkey""",
)
def an10(spark, sf):
    clusters = b.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("tag")).agg(
        F.array_join(F.collect_set((F.col("o_orderkey") % 2000).cast("string")), ", ").alias("members")
    )
    genes = b.table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_partkey").cast("string").alias("locustag"))
    return a.attach_orthologs(genes, clusters).select("gene", "tag")


@query(
    "an11_find_gene",
    f"""WITH {SQL_CONTIG_GENES} SELECT gene, cg.start <= 0 AS at_contig_start, cg."end" >= len AS at_contig_end, cg.seq FROM cg JOIN dl ON dl.doc_id = contig
    JOIN (SELECT doc_id, lower(source || '_' || lang) AS attr FROM documents) d ON d.doc_id = contig WHERE contains(attr, 'c1')""",
)
def an11(spark, sf):
    docs = b.sequences(spark, sf)
    contigs = docs.select(F.col("doc_id").alias("contig"), "seq", F.length("seq").cast("long").alias("len"))
    attr = docs.select(F.col("doc_id").alias("contig"), F.concat_ws("_", "source", "lang").alias("attributes"))
    genes = b.contig_genes(spark, sf).drop("seq").join(attr, "contig")
    found = a.find_gene(genes, contigs, "C1")
    return a.extract_gene_seq(found, contigs).select("gene", "at_contig_start", "at_contig_end", "seq")


@query(
    "an12_label_table",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'LT' || replace(replace('XY_' || p_partkey, 'XY', ''), '_', '') || ';' || p_type
      ELSE p_type || ';' || p_brand END AS label,
      CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_brand || '(' || -p_size || ') / ' || p_type || '(' || p_size || ')' ELSE p_type || '(' || p_size || ')' END AS around
    FROM part""",
)
def an12(spark, sf):
    part = b.table(spark, sf, "part")
    gene = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(".;"), "p_type")).otherwise(F.concat_ws(";", "p_type", "p_brand"))
    tag = F.concat(F.lit("c1:XY_"), F.col("p_partkey"), F.lit(";c1:XY_9"))
    none = F.lit(None).cast("string")
    return part.select(
        "p_partkey",
        a.short_locus(gene, tag, "XY").alias("label"),
        a.neighbour_text(
            F.when(F.col("p_size") % 3 == 0, F.col("p_name")),
            F.when(F.col("p_size") % 3 == 1, F.col("p_brand")).otherwise(none),
            -F.col("p_size"),
            F.col("p_type"),
            F.col("p_size"),
        ).alias("around"),
    )


SQL_GENOTYPE = """li AS (SELECT l_orderkey AS isolate, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS kind, l_linenumber AS ord, l_suppkey,
   CASE WHEN l_tax > 0.01 THEN l_partkey % 4 END AS call, CASE WHEN l_discount > 0.02 THEN l_suppkey % 4 END AS anc, l_orderkey % 4 AS ref, l_returnflag || l_linenumber AS label FROM lineitem),
   gt AS (SELECT isolate, coalesce(string_agg(label, '; ' ORDER BY kind, ord, label) FILTER (call IS NOT NULL AND call <> coalesce(anc, ref)), 'ancestral') AS genotype FROM li GROUP BY 1)"""


def genotypes(spark, sf):
    li = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("isolate"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("kind"),
        F.col("l_linenumber").alias("ord"),
        F.concat("l_returnflag", "l_linenumber").alias("label"),
        F.when(F.col("l_tax") > 0.01, F.col("l_partkey") % 4).alias("call"),
        F.when(F.col("l_discount") > 0.02, F.col("l_suppkey") % 4).alias("anc"),
        (F.col("l_orderkey") % 4).alias("ref"),
    )
    return a.isolate_genotype(li)


@query("an13_isolate_genotype", f"WITH {SQL_GENOTYPE} SELECT isolate, genotype FROM gt")
def an13(spark, sf):
    return genotypes(spark, sf)


@query(
    "an13_genotype_frequency",
    f"""WITH {SQL_GENOTYPE}, t AS (SELECT strftime(o_orderdate, '%Y-%m') AS time, genotype FROM gt JOIN orders ON o_orderkey = isolate),
    c AS (SELECT time, genotype, count(*) AS n FROM t GROUP BY 1, 2)
    SELECT time, genotype, n, round(n * 1.0 / sum(n) OVER (PARTITION BY time), 6) AS freq FROM c""",
)
def an13_freq(spark, sf):
    times = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("isolate"), F.date_format("o_orderdate", "yyyy-MM").alias("time"))
    return a.genotype_frequency(genotypes(spark, sf).join(times, "isolate")).withColumn("freq", R("freq", 6))


# ---- recombination ----

SQL_AF = """af AS (SELECT l_partkey % 2000 AS p, l_suppkey % 25 AS sample, l_linenumber % 2 AS allele, count(*) FILTER (l_returnflag = 'A') * 1.0 / count(*) AS x FROM lineitem GROUP BY 1, 2, 3),
cell AS (SELECT p, sample, max(x) AS x FROM af GROUP BY 1, 2 HAVING max(x) > 0),
st AS (SELECT DISTINCT p FROM cell), sm AS (SELECT range AS sample FROM range(25)),
dense AS (SELECT st.p, sm.sample, coalesce(x, 0.0) AS x FROM st CROSS JOIN sm LEFT JOIN cell c ON c.p = st.p AND c.sample = sm.sample)"""


def frequencies(spark, sf):
    return b.table(spark, sf, "lineitem").groupBy(
        (F.col("l_partkey") % 2000).alias("p"), (F.col("l_suppkey") % 25).alias("sample"), (F.col("l_linenumber") % 2).alias("allele")
    ).agg((F.count_if(F.col("l_returnflag") == "A") / F.count(F.lit(1))).alias("x"))


def site_frequencies(spark, sf):
    return frequencies(spark, sf).groupBy("p", "sample").agg(F.max("x").alias("x")).where("x > 0")


@query(
    "rc1_local_correlation",
    f"""WITH {SQL_AF}, pr AS (SELECT a.p AS pa, b.p AS pb, corr(a.x, b.x) AS r FROM dense a JOIN dense b ON a.sample = b.sample AND a.p < b.p AND b.p - a.p < 10 GROUP BY 1, 2)
    SELECT pa, pb, round(r, 6) AS r FROM pr WHERE r > 0.6 AND EXISTS (SELECT 1 FROM st WHERE st.p > 5 AND abs(st.p - pa) < 5 AND abs(st.p - pb) < 5)""",
)
def rc1(spark, sf):
    pairs = rc.local_correlation(site_frequencies(spark, sf), n_samples=25, distance=5, threshold=0.6)
    return pairs.select(F.col("a.p").alias("pa"), F.col("b.p").alias("pb"), R("r", 6).alias("r"))


@query(
    "rc2_per_allele_correlation",
    f"""WITH {SQL_AF}, k AS (SELECT DISTINCT p, allele FROM af WHERE x > 0), d2 AS (SELECT k.p, k.allele, sm.sample, coalesce(x, 0.0) AS x FROM k CROSS JOIN sm
      LEFT JOIN af ON af.p = k.p AND af.allele = k.allele AND af.sample = sm.sample),
    pr AS (SELECT a.p AS pa, a.allele AS la, b.p AS pb, b.allele AS lb, corr(a.x, b.x) AS r FROM d2 a JOIN d2 b ON a.sample = b.sample AND (a.p, a.allele) < (b.p, b.allele) AND b.p - a.p < 10
      GROUP BY 1, 2, 3, 4),
    ok AS (SELECT * FROM pr WHERE r > 0.6 AND EXISTS (SELECT 1 FROM k WHERE k.p > 5 AND abs(k.p - pa) < 5 AND abs(k.p - pb) < 5)),
    fl AS (SELECT pa AS p, la AS allele FROM ok UNION SELECT pb, lb FROM ok),
    m AS (SELECT af.p, fl.p IS NOT NULL AS rec FROM af LEFT JOIN fl ON fl.p = af.p AND fl.allele = af.allele WHERE x > 0)
    SELECT p, bool_and(rec) AS dropped, bool_or(rec) AND NOT bool_and(rec) AS partial FROM m GROUP BY 1""",
)
def rc2(spark, sf):
    return rc.per_allele_correlation(frequencies(spark, sf), n_samples=25, distance=5, threshold=0.6)[1]


@query(
    "rc3_local_covariance",
    f"""WITH {SQL_AF}, pr AS (SELECT a.p AS f, b.p AS m, covar_samp(a.x, b.x) AS c FROM dense a JOIN dense b ON a.sample = b.sample AND abs(a.p - b.p) < 5 GROUP BY 1, 2),
    t AS (SELECT f, max(c) AS top FROM pr GROUP BY 1), q AS (SELECT pr.f, m FROM pr JOIN t ON t.f = pr.f WHERE c > top * 0.9 AND top > 1e-12)
    SELECT DISTINCT m AS p FROM q WHERE f IN (SELECT f FROM q GROUP BY 1 HAVING count(*) > 1)""",
)
def rc3(spark, sf):
    return rc.local_covariance(site_frequencies(spark, sf), n_samples=25, distance=5, fraction=0.9)


@query(
    "rc4_mask_recomb_intervals",
    """WITH iv AS (SELECT o_orderkey % 5000 AS s, o_orderkey % 5000 + o_custkey % 6 AS e, o_custkey % 100 AS t1, (o_custkey * 3 + 1) % 100 AS t2 FROM orders),
    tx AS (SELECT s, e, t1 AS sample FROM iv UNION ALL SELECT s, e, t2 FROM iv),
    c AS (SELECT l_suppkey % 100 AS sample, l_orderkey * 7 % 5000 AS p, max(l_linenumber) AS call FROM lineitem GROUP BY 1, 2)
    SELECT sample, p, CASE WHEN hit THEN NULL ELSE call END AS call, hit AS recombinant FROM (
      SELECT c.*, EXISTS (SELECT 1 FROM tx WHERE tx.sample = c.sample AND c.p + (c.p // 2500) * 5 >= s AND c.p + (c.p // 2500) * 5 < e) AS hit FROM c)""",
)
def rc4(spark, sf):
    orders = b.table(spark, sf, "orders")
    taxa = F.concat(F.col("o_custkey") % 100, F.lit(" "), (F.col("o_custkey") * 3 + 1) % 100)
    intervals = orders.select(
        (F.col("o_orderkey") % 5000).alias("start"), (F.col("o_orderkey") % 5000 + F.col("o_custkey") % 6).alias("end"), taxa.alias("taxa")
    )
    calls = b.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 100).alias("sample"), (F.col("l_orderkey") * 7 % 5000).alias("p")).agg(
        F.max("l_linenumber").alias("call")
    )
    named = calls.select(F.col("sample").cast("string").alias("sample"), "p", "call", (F.floor(F.col("p") / 2500) + 1).alias("contig_idx"))
    out = rc.mask_recomb_intervals(named, intervals, None, padding=5, width=16)
    return out.select(F.col("sample").cast("long").alias("sample"), "p", "call", "recombinant")


SQL_SWEEP = SQL_INTERVALS + """,
b0 AS (SELECT DISTINCT start AS pos FROM iv WHERE "end" > start UNION SELECT DISTINCT "end" FROM iv WHERE "end" > start),
days AS (SELECT DISTINCT sample, unnest(range(start, "end")) AS d FROM iv),
act AS (SELECT d, count(*) AS n FROM days GROUP BY 1)"""


@query(
    "rc5_depth_segments",
    f"""WITH {SQL_SWEEP} SELECT d, n AS n_active FROM act""",
)
def rc5(spark, sf):
    segments = rc.depth_segments(b.order_intervals(spark, sf), tile_width=365)
    return segments.select(F.explode(F.sequence("start", F.col("end") - 1)).alias("d"), "n_active")


@query(
    "rc5_depth_shares",
    f"""WITH {SQL_SWEEP}, k AS (SELECT n AS n_active, count(*) AS bases FROM act GROUP BY 1)
    SELECT n_active, bases, round(n_active * 1.0 / (SELECT count(DISTINCT sample) FROM iv), 6) AS share_samples, round(sum(bases) OVER (ORDER BY n_active DESC) * 1.0 / sum(bases) OVER (), 6) AS cum_share FROM k""",
)
def rc5_shares(spark, sf):
    intervals = b.order_intervals(spark, sf)
    out = rc.depth_shares(rc.depth_segments(intervals, tile_width=365), n_samples=intervals.agg(F.count_distinct("sample")).scalar())
    return out.select("n_active", "bases", R("share_samples", 6).alias("share_samples"), R("cum_share", 6).alias("cum_share"))
