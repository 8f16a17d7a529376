"""Queries over codon usage, selection statistics and null tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from variascope import bindings as b
from variascope.bindings import SQL_SEQUENCES
from variascope.catalog.annotate import SQL_ANNOTATED, annotated
from variascope.operators import evolution as e
from variascope.registry import query

R = F.round

SQL_CODONS = SQL_SEQUENCES + """,
cod AS (SELECT doc_id, lang, substr(seq, i * 3 + 1, 3) AS codon FROM (SELECT doc_id, lang, seq, unnest(range(length(seq) // 3)) AS i FROM sequences)),
code AS (SELECT substr('TCAG', CAST(i + 1 AS BIGINT), 1) || substr('TCAG', CAST(j + 1 AS BIGINT), 1) || substr('TCAG', CAST(k + 1 AS BIGINT), 1) AS codon,
   substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(16 * i + 4 * j + k + 1 AS BIGINT), 1) AS aa
   FROM range(4) x(i), range(4) y(j), range(4) z(k)),
subs AS (SELECT x.b AS f, y.b AS t FROM (VALUES ('A'), ('T'), ('G'), ('C')) x(b), (VALUES ('A'), ('T'), ('G'), ('C')) y(b) WHERE x.b <> y.b),
ns AS (SELECT c.codon, f || t AS sub, count(*) AS bases, avg(CASE WHEN d.aa <> c.aa THEN 1.0 ELSE 0.0 END) AS p_nonsyn
  FROM code c CROSS JOIN subs CROSS JOIN range(3) r(i) JOIN code d ON d.codon = substr(c.codon, 1, i) || t || substr(c.codon, i + 2)
  WHERE substr(c.codon, i + 1, 1) = f GROUP BY 1, 2)"""

# The same tables under other names, without the sequences, to sit next to the annotation tables.
SQL_CODONS2 = re.sub(r"\bcod(e?)\b(?! AS \(SELECT doc_id AS)", r"cod\g<1>2", SQL_CODONS.replace(SQL_SEQUENCES + ",", "")).replace("AS cod2on", "AS codon")


def genes_as_sequences(spark, sf):
    return b.sequences(spark, sf)


@query("ev1_codon_usage", f"WITH {SQL_CODONS} SELECT codon, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM cod GROUP BY 1")
def ev1(spark, sf):
    return e.codon_usage(genes_as_sequences(spark, sf)).withColumn("share", R("share", 6))


@query(
    "ev1_codon_usage_per_gene",
    f"WITH {SQL_CODONS} SELECT doc_id, codon, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY doc_id), 6) AS share FROM cod GROUP BY 1, 2",
)
def ev1_gene(spark, sf):
    return e.codon_usage(genes_as_sequences(spark, sf), by=["doc_id"]).withColumn("share", R("share", 6))


@query(
    "ev2_nonsyn_table",
    f"""WITH {SQL_CODONS}, u AS (SELECT codon, count(*) AS n FROM cod GROUP BY 1)
    SELECT ns.codon, sub, bases, round(p_nonsyn, 6) AS p_nonsyn, n * bases AS sites FROM ns JOIN u ON u.codon = ns.codon""",
)
def ev2(spark, sf):
    usage = e.codon_usage(genes_as_sequences(spark, sf))
    rows = e.nonsyn_table(spark).where("bases > 0").join(usage, "codon")
    return rows.select(
        "codon", "sub", F.col("bases").cast("long").alias("bases"), R("p_nonsyn", 6).alias("p_nonsyn"),
        (F.col("n") * F.col("bases")).alias("sites"),
    )


@query(
    "ev3_expected_pn",
    f"""WITH {SQL_CODONS}, u AS (SELECT codon, count(*) AS n FROM cod GROUP BY 1),
    s AS (SELECT sub, sum(n * bases * p_nonsyn) / sum(n * bases) AS p FROM ns JOIN u ON u.codon = ns.codon GROUP BY 1)
    SELECT round(sum(p) / 12, 6) AS p_n FROM s""",
)
def ev3(spark, sf):
    return e.expected_pn(e.codon_usage(genes_as_sequences(spark, sf)), e.nonsyn_table(spark)).withColumn("p_n", R("p_n", 6))


@query(
    "ev3_expected_pn_per_gene",
    f"""WITH {SQL_CODONS}, u AS (SELECT doc_id, codon, count(*) AS n FROM cod GROUP BY 1, 2),
    s AS (SELECT doc_id, sub, sum(n * bases * p_nonsyn) / sum(n * bases) AS p FROM ns JOIN u ON u.codon = ns.codon GROUP BY 1, 2)
    SELECT doc_id, round(CASE WHEN count(*) = 12 THEN sum(p) / 12 END, 6) AS p_n FROM s GROUP BY 1""",
)
def ev3_gene(spark, sf):
    usage = e.codon_usage(genes_as_sequences(spark, sf), by=["doc_id"])
    return e.expected_pn(usage, e.nonsyn_table(spark), by=["doc_id"]).withColumn("p_n", R("p_n", 6))


@query(
    "ev4_observed_ns",
    f"""WITH {SQL_ANNOTATED}, c AS (SELECT gene, CAST(sum(length(type) - length(replace(type, 'N', ''))) AS BIGINT) AS a, CAST(sum(length(type) - length(replace(type, 'S', ''))) AS BIGINT) AS s FROM ann GROUP BY 1),
    w AS (SELECT *, a + s AS n, CASE WHEN a + s > 0 THEN a * 1.0::DOUBLE / (a + s) END AS p, 1.959963984540054::DOUBLE AS z FROM c)
    SELECT gene, a AS n_nonsyn, s AS n_syn, round(p, 6) AS p_obs, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS ci_low,
      round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS ci_high FROM w WHERE n > 0""",
)
def ev4(spark, sf):
    out = e.observed_ns(annotated(spark, sf).where(F.col("gene").isNotNull()), by=["gene"]).where("n_nonsyn + n_syn > 0")
    return out.select("gene", "n_nonsyn", "n_syn", *[R(c, 6).alias(c) for c in ("p_obs", "ci_low", "ci_high")])


# P(X >= k) of a binomial as a plain sum of log-gamma terms.
BINOM_GE = "(1 - coalesce(list_sum(list_transform(range({k}), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p})))), 0))"
POISSON_GE = "(1 - coalesce(list_sum(list_transform(range({k}), lambda i: exp(-{r} + i * ln({r}) - lgamma(i + 1)))), 0))"


@query(
    "ev4_ns_binomial",
    f"""WITH {SQL_ANNOTATED}, {SQL_CODONS2},
    u AS (SELECT doc_id, codon, count(*) AS n FROM cod2 GROUP BY 1, 2),
    s AS (SELECT doc_id, sub, sum(n * bases * p_nonsyn) / sum(n * bases) AS p FROM ns JOIN u ON u.codon = ns.codon GROUP BY 1, 2),
    ex AS (SELECT doc_id, CASE WHEN count(*) = 12 THEN sum(p) / 12 END AS p_n FROM s GROUP BY 1),
    ob AS (SELECT contig AS doc_id, CAST(sum(length(type) - length(replace(type, 'N', ''))) AS BIGINT) AS a, CAST(sum(length(type) - length(replace(type, 'S', ''))) AS BIGINT) AS s FROM ann GROUP BY 1)
    SELECT ob.doc_id, a AS n_nonsyn, ob.s AS n_syn, round(p_n, 6) AS p_n, round({BINOM_GE.format(k='a', n='(a + ob.s)', p='p_n')}, 6) AS p_excess_n,
      round({BINOM_GE.format(k='ob.s', n='(a + ob.s)', p='(1 - p_n)')}, 6) AS p_excess_s FROM ob JOIN ex ON ex.doc_id = ob.doc_id WHERE p_n IS NOT NULL""",
)
def ev4_binomial(spark, sf):
    genes = annotated(spark, sf).where(F.col("gene").isNotNull()).withColumn("doc_id", F.col("contig"))
    observed = e.observed_ns(genes, by=["doc_id"])
    expected = e.expected_pn(e.codon_usage(genes_as_sequences(spark, sf), by=["doc_id"]), e.nonsyn_table(spark), by=["doc_id"])
    out = e.ns_binomial(observed, expected.where("p_n IS NOT NULL"), by=["doc_id"])
    return out.select("doc_id", "n_nonsyn", "n_syn", *[R(c, 6).alias(c) for c in ("p_n", "p_excess_n", "p_excess_s")])


SQL_TALLY = """m0 AS (SELECT l_suppkey % 3 AS contig, l_orderkey % 20000 AS p, min(l_partkey) AS gene, count(*) AS alleles, count(*) FILTER (l_linenumber % 2 = 0) AS nonsyn FROM lineitem GROUP BY 1, 2),
m1 AS (SELECT m0.*, p_size * 3 AS gene_len FROM m0 JOIN part ON p_partkey = gene),
m2 AS (SELECT * FROM m1 a WHERE NOT EXISTS (SELECT 1 FROM m0 b WHERE b.contig = a.contig AND b.p = a.p + 1)),
tally AS (SELECT gene, CAST(sum(alleles) AS BIGINT) AS n_events, CAST(sum(nonsyn) AS BIGINT) AS n_nonsyn, CAST(sum(alleles - nonsyn) AS BIGINT) AS n_syn, max(gene_len) AS len,
  sum(alleles) * 1.0 / max(gene_len) AS density FROM m2 GROUP BY 1)"""


def tally(spark, sf):
    li = b.table(spark, sf, "lineitem")
    muts = li.groupBy((F.col("l_suppkey") % 3).alias("contig"), (F.col("l_orderkey") % 20000).alias("p")).agg(
        F.min("l_partkey").alias("gene"), F.count(F.lit(1)).alias("alleles"), F.count_if(F.col("l_linenumber") % 2 == 0).alias("nonsyn")
    ).withColumn("events", F.col("alleles"))
    lengths = b.table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") * 3).alias("gene_len"))
    return e.gene_tally(e.drop_leading_adjacent(muts).join(lengths, "gene"), min_count=3, min_density=0.1)


@query(
    "ev5_gene_tally",
    f"WITH {SQL_TALLY} SELECT gene, n_events, n_nonsyn, n_syn, len, round(density, 6) AS density, n_events >= 3 AND density >= 0.1 AS candidate FROM tally",
)
def ev5(spark, sf):
    return tally(spark, sf).withColumn("density", R("density", 6))


@query(
    "ev9_gene_tail_p",
    f"""WITH {SQL_TALLY} SELECT gene, n_events, n_nonsyn, n_syn, len, round(density, 6) AS density, round((SELECT sum(n_events) FROM tally) * len / (SELECT sum(p_size * 3) FROM part), 6) AS lambda,
    0.05 / (SELECT count(*) FROM part) AS threshold FROM tally WHERE n_events >= 3 AND density >= 0.1""",
)
def ev9(spark, sf):
    rows = tally(spark, sf)
    coding = b.table(spark, sf, "part").agg(F.sum(F.col("p_size") * 3)).scalar()
    out = e.gene_tail_p(
        rows, total=rows.agg(F.sum("n_events")).scalar(), callable_median=coding, coding_length=coding,
        n_genes=b.table(spark, sf, "part").agg(F.count(F.lit(1))).scalar(),
    )
    return out.drop("p_ge", "p_gt", "p_gt_binom").withColumn("density", R("density", 6)).withColumn("lambda", R("lambda", 6))


@query(
    "ev9_gene_tail_p_values",
    f"""WITH {SQL_TALLY}, t AS (SELECT *, (SELECT sum(n_events) FROM tally)::DOUBLE * len / (SELECT sum(p_size * 3) FROM part) AS r, (SELECT sum(n_events) FROM tally)::DOUBLE / (SELECT sum(p_size * 3) FROM part) AS q FROM tally WHERE n_events >= 3 AND density >= 0.1)
    SELECT gene, n_events, round({POISSON_GE.format(k='n_events', r='r')}, 6) AS p_ge, round({POISSON_GE.format(k='n_events + 1', r='r')}, 6) AS p_gt,
      round({BINOM_GE.format(k='n_events + 1', n='len', p='q')}, 6) AS p_gt_binom FROM t""",
)
def ev9_values(spark, sf):
    rows = tally(spark, sf)
    coding = b.table(spark, sf, "part").agg(F.sum(F.col("p_size") * 3)).scalar()
    out = e.gene_tail_p(
        rows, total=rows.agg(F.sum("n_events")).scalar(), callable_median=coding, coding_length=coding,
        n_genes=b.table(spark, sf, "part").agg(F.count(F.lit(1))).scalar(),
    )
    return out.select("gene", "n_events", *[R(c, 6).alias(c) for c in ("p_ge", "p_gt", "p_gt_binom")])


SQL_COMBINED = """snv AS (SELECT l_partkey AS gene, l_orderkey AS p, count(*) AS events, any_value(p_name) AS name, any_value(p_brand) AS product
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 2 = 1 GROUP BY 1, 2),
ind AS (SELECT unnest([l_partkey, l_suppkey]) AS gene, l_orderkey AS p, 1 + l_suppkey % 2 AS events, p_name AS name, p_brand AS product
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 2 = 0),
al AS (SELECT * FROM snv UNION ALL SELECT * FROM ind),
comb AS (SELECT gene, CAST(sum(events) AS BIGINT) AS n_events, first(name ORDER BY p, name, product) AS name, first(product ORDER BY p, name, product) AS product
  FROM al GROUP BY 1)"""


def combined(spark, sf):
    li = b.table(spark, sf, "lineitem")
    part = b.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("product"))
    snvs = li.where("l_linenumber % 2 = 1").groupBy(F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("p")).agg(
        F.count(F.lit(1)).alias("events")
    ).join(part, F.col("gene") == F.col("p_partkey"))
    indels = li.where("l_linenumber % 2 = 0").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.array("l_partkey", "l_suppkey").alias("genes"), F.col("l_orderkey").alias("p"),
        F.array_repeat(F.lit("x"), (1 + F.col("l_suppkey") % 2).cast("int")).alias("alts"), "name", "product",
    )
    return e.combined_gene_counts(snvs, indels)


@query("ev10_combined_gene_counts", f"WITH {SQL_COMBINED} SELECT gene, n_events, name, product FROM comb")
def ev10(spark, sf):
    return combined(spark, sf)


SQL_DNDS = """gn AS (SELECT l_partkey AS gene, count(*) FILTER (l_linenumber % 3 <> 0) AS a, count(*) FILTER (l_linenumber % 3 = 0) AS s, (max(p_size) + 40) / 100.0::DOUBLE AS p, avg(l_discount) AS support
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
dn AS (SELECT *, a / ((a + s) * p) AS dn, s / ((a + s) * (1 - p)) AS ds FROM gn WHERE s > 0)"""


@query(
    "ev11_dnds_percentile",
    f"""WITH {SQL_DNDS} SELECT gene, round(dn, 6) AS dn, round(ds, 6) AS ds, round(dn / ds, 6) AS dnds, round(support, 6) AS support FROM dn""",
)
def ev11(spark, sf):
    out = dnds(spark, sf)
    return out.select("gene", *[R(c, 6).alias(c) for c in ("dn", "ds", "dnds", "support")])


@query(
    "ev11_dnds_ranks",
    f"""WITH {SQL_DNDS}, q AS (SELECT gene, a * (100 - CAST(round(p * 100) AS BIGINT)) * 1000000000 // (s * CAST(round(p * 100) AS BIGINT)) AS k FROM dn)
    SELECT gene, round(percent_rank() OVER (ORDER BY k) * 100, 6) AS percentile FROM q""",
)
def ev11_ranks(spark, sf):
    rows = dnds_input(spark, sf).where("n_syn > 0")
    # Exact integer ratio so that equal ratios tie in both engines.
    size = F.round(F.col("p_n") * 100).cast("long")
    key = F.floor(F.col("n_nonsyn") * (100 - size) * 1000000000 / (F.col("n_syn") * size)).cast("long")
    keyed = rows.select("gene", key.alias("k"))
    ranks = e.value_ranks(keyed, keys=[], value="k", tile=e.value_tiles(keyed, "k", 16))
    last = keyed.agg(F.count(F.lit(1)) - 1).scalar()
    return keyed.join(ranks.select("k", "below"), "k").select("gene", R(F.col("below") / last * 100, 6).alias("percentile"))


def dnds_input(spark, sf):
    li = b.table(spark, sf, "lineitem").join(b.table(spark, sf, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.col("l_partkey").alias("gene")).agg(
        F.count_if(F.col("l_linenumber") % 3 != 0).alias("n_nonsyn"), F.count_if(F.col("l_linenumber") % 3 == 0).alias("n_syn"),
        ((F.max("p_size") + 40) / 100.0).alias("p_n"), F.avg("l_discount").alias("support"),
    )


def dnds(spark, sf):
    return e.dnds_percentile(dnds_input(spark, sf))


SQL_CHI = """cnt AS (SELECT l_suppkey AS sample, l_returnflag AS cls, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2),
bg AS (SELECT l_returnflag AS cls, count(*) AS bn FROM lineitem WHERE l_quantity <= 40 GROUP BY 1),
f AS (SELECT s.sample, bg.cls, coalesce(n, 0) AS n, bn FROM (SELECT DISTINCT sample FROM cnt) s CROSS JOIN bg LEFT JOIN cnt ON cnt.sample = s.sample AND cnt.cls = bg.cls),
w AS (SELECT *, sum(n) OVER p AS r1, sum(bn) OVER p AS r2 FROM f WINDOW p AS (PARTITION BY sample)),
x AS (SELECT *, r1 * (n + bn) * 1.0::DOUBLE / (r1 + r2) AS e1, r2 * (n + bn) * 1.0::DOUBLE / (r1 + r2) AS e2 FROM w)"""


def chi2(spark, sf):
    li = b.table(spark, sf, "lineitem")
    n = F.count(F.lit(1)).alias("n")
    counts = li.where("l_quantity > 40").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("cls")).agg(n)
    background = li.where("l_quantity <= 40").groupBy(F.col("l_returnflag").alias("cls")).agg(n)
    return e.spectrum_chi2(counts, background, keys=["sample"])


@query(
    "ev12_spectrum_chi2",
    f"""WITH {SQL_CHI} SELECT sample, round(sum((n - e1) * (n - e1) / e1 + (bn - e2) * (bn - e2) / e2), 6) AS chi2, count(*) - 1 AS df, CAST(max(r1) AS BIGINT) AS n_mutations,
    round(exp(-sum((n - e1) * (n - e1) / e1 + (bn - e2) * (bn - e2) / e2) / 2), 6) AS p_value FROM x GROUP BY 1""",
)
def ev12(spark, sf):
    # Three classes give two degrees of freedom, whose tail is exp(-x/2): checked in closed form.
    return chi2(spark, sf).select("sample", R("chi2", 6).alias("chi2"), "df", "n_mutations", R("p_value", 6).alias("p_value"))


@query(
    "ev13_mean_called_share",
    """WITH w AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority || ';' || o_orderstatus ELSE o_orderpriority END AS locustag,
      CASE WHEN o_orderkey % 3 = 0 THEN '?' ELSE 'A' END AS s1, CASE WHEN o_custkey % 4 = 0 THEN '?' ELSE 'C' END AS s2, CASE WHEN o_totalprice > 300000 THEN '?' ELSE 'G' END AS s3 FROM orders)
    SELECT locustag, round(avg(((s1 <> '?')::INT + (s2 <> '?')::INT + (s3 <> '?')::INT) / 3.0), 6) AS support, count(*) AS n_sites FROM w WHERE NOT contains(locustag, ';') GROUP BY 1""",
)
def ev13(spark, sf):
    o = b.table(spark, sf, "orders")
    wide = o.select(
        F.when(F.col("o_orderkey") % 11 == 0, F.concat_ws(";", "o_orderpriority", "o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("locustag"),
        F.when(F.col("o_orderkey") % 3 == 0, "?").otherwise("A").alias("s1"),
        F.when(F.col("o_custkey") % 4 == 0, "?").otherwise("C").alias("s2"),
        F.when(F.col("o_totalprice") > 300000, "?").otherwise("G").alias("s3"),
    )
    return e.mean_called_share(wide, sample_columns=["s1", "s2", "s3"]).withColumn("support", R("support", 6))
