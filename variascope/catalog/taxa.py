"""Queries over taxonomic and assembly tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from variascope import bindings as b
from variascope.operators import taxa as x
from variascope.registry import query

R = F.round
CONTROLS = "0$"

SQL_TAX = """rev AS (SELECT l_suppkey, p_brand, sum(l_extendedprice) AS r, count(*) AS reads FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
tot AS (SELECT l_suppkey, sum(l_extendedprice) AS t FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
tax AS (SELECT 'S' || rev.l_suppkey AS sample, p_brand AS taxon, round(r / t * 100, 4) AS pct, reads FROM rev JOIN tot ON tot.l_suppkey = rev.l_suppkey),
man AS (SELECT 'S' || s_suppkey AS sample, 'Brand#' || (s_nationkey + 1) AS taxon, CASE WHEN s_nationkey < 20 THEN 'N' || s_nationkey END AS subject FROM supplier),
lin AS (SELECT p_brand AS taxon, min(p_type) AS genus FROM part GROUP BY 1)"""


def tax(spark, sf):
    li = b.table(spark, sf, "lineitem").join(
        b.table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    revenue = li.groupBy("l_suppkey", "p_brand").agg(F.sum("l_extendedprice").alias("r"), F.count(F.lit(1)).alias("reads"))
    total = revenue.groupBy("l_suppkey").agg(F.sum("r").alias("t"))
    return revenue.join(total, "l_suppkey").select(
        F.concat(F.lit("S"), "l_suppkey").alias("sample"), F.col("p_brand").alias("taxon"),
        R(F.col("r") / F.col("t") * 100, 4).alias("pct"), "reads",
    )


def manifest(spark, sf):
    return b.table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("sample"),
        F.concat(F.lit("Brand#"), F.col("s_nationkey") + 1).alias("taxon"),
        F.when(F.col("s_nationkey") < 20, F.concat(F.lit("N"), "s_nationkey")).alias("subject"),
    )


def lineages(spark, sf):
    return b.table(spark, sf, "part").groupBy(F.col("p_brand").alias("taxon")).agg(F.min("p_type").alias("genus"))


@query(
    "tx1_top_hit",
    f"""WITH {SQL_TAX}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY pct DESC, taxon) AS k FROM tax) SELECT sample, taxon, pct FROM r WHERE k = 1""",
)
def tx1(spark, sf):
    return x.top_hit(tax(spark, sf))


@query(
    "tx1_top_k",
    f"""WITH {SQL_TAX}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample ORDER BY pct DESC, taxon) AS INTEGER) AS rank FROM tax)
    SELECT sample, taxon, pct, reads, rank FROM r WHERE rank <= 3""",
)
def tx1_k(spark, sf):
    return x.top_k(tax(spark, sf), 3)


@query(
    "tx2_typing_candidates",
    f"""WITH {SQL_TAX}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY pct DESC, taxon) AS k FROM tax),
    sch AS (SELECT DISTINCT 'Brand#' || p_size % 9 || '#' || p_type AS scheme, 'Brand#' || p_size % 9 AS t FROM part)
    SELECT sample, 'Brand:' || substr(taxon, 7) AS taxon, replace(scheme, 'Brand#', 'Brand:') AS scheme FROM r JOIN sch ON t = taxon WHERE k = 1""",
)
def tx2(spark, sf):
    tops = x.top_hit(tax(spark, sf)).withColumn("taxon", F.replace(F.col("taxon"), F.lit("#"), F.lit(":")))
    schemes = b.table(spark, sf, "part").select(
        F.concat(F.lit("Brand:"), F.col("p_size") % 9, F.lit("#"), "p_type").alias("scheme")
    ).distinct()
    return x.typing_candidates(tops, schemes)


SQL_EXPECTED = SQL_TAX + """, ex AS (SELECT t.sample, t.taxon, pct, reads, coalesce(subject, 'unknown') AS subject, genus FROM tax t
  JOIN man m ON m.sample = t.sample AND m.taxon = t.taxon JOIN lin ON lin.taxon = t.taxon WHERE NOT regexp_matches(t.sample, '0$'))"""


def expected(spark, sf):
    return x.expected_taxa(tax(spark, sf), manifest(spark, sf), lineages(spark, sf), controls=CONTROLS)


@query("tx3_expected_taxa", f"WITH {SQL_EXPECTED} SELECT * FROM ex")
def tx3(spark, sf):
    return expected(spark, sf)


@query(
    "tx4_pass_ratio",
    f"""WITH {SQL_EXPECTED} SELECT subject, taxon, round(avg(CASE WHEN pct >= 4 THEN 1.0 ELSE 0.0 END), 6) AS ratio, count(*) FILTER (pct >= 4) AS n_pass FROM ex GROUP BY 1, 2""",
)
def tx4(spark, sf):
    return x.pass_ratio(expected(spark, sf), cutoff=4).withColumn("ratio", R("ratio", 6))


SQL_FAILED = SQL_TAX + """, f AS (SELECT t.*, m.taxon AS expected, subject FROM tax t LEFT JOIN man m ON m.sample = t.sample
  WHERE ((pct < 4 AND t.taxon = m.taxon) OR m.taxon IS NULL OR t.taxon <> m.taxon) AND NOT regexp_matches(t.sample, '0$'))"""


def failed(spark, sf):
    return x.fail_list(tax(spark, sf), manifest(spark, sf), cutoff=4, controls=CONTROLS)


@query("tx5_fail_list", f"WITH {SQL_FAILED} SELECT * FROM f")
def tx5(spark, sf):
    return failed(spark, sf)


@query(
    "tx5_contaminant_summary",
    f"WITH {SQL_FAILED} SELECT taxon, count(*) AS n, round(median(round(pct * 100)) / 100, 6) AS median_pct FROM f GROUP BY 1",
)
def tx5_summary(spark, sf):
    return x.contaminant_summary(failed(spark, sf)).withColumn("median_pct", R("median_pct", 6))


@query(
    "tx6_rank_vs_rank",
    f"""WITH {SQL_TAX}, g AS (SELECT sample, genus, round(sum(pct), 6) AS high_pct FROM tax JOIN lin ON lin.taxon = tax.taxon GROUP BY 1, 2)
    SELECT t.sample, t.taxon, pct AS low_pct, lin.genus AS parent, high_pct FROM tax t JOIN lin ON lin.taxon = t.taxon JOIN g ON g.sample = t.sample AND g.genus = lin.genus""",
)
def tx6(spark, sf):
    rows, parents = tax(spark, sf), lineages(spark, sf).withColumnRenamed("genus", "parent")
    upper = rows.join(parents, "taxon").groupBy("sample", F.col("parent").alias("taxon")).agg(R(F.sum("pct"), 6).alias("pct"))
    both = rows.select("sample", "taxon", "pct", F.lit("S").alias("rank")).unionByName(upper.withColumn("rank", F.lit("G")))
    return x.rank_vs_rank(both, parents, low="S", high="G")


@query("tx7_pct_histogram", f"WITH {SQL_TAX} SELECT taxon, CAST(floor(pct) AS BIGINT) AS bin, count(*) AS n FROM tax GROUP BY 1, 2")
def tx7(spark, sf):
    return x.pct_histogram(tax(spark, sf))


def contigs(spark, sf):
    """Contigs = documents, assembly = language and source, coverage from the document number."""
    return b.table(spark, sf, "documents").select(
        F.concat_ws("-", "lang", "source").alias("assembly"), F.col("doc_id").alias("idx"), F.col("n_chars").alias("len"),
        ((F.col("doc_id") * 37 % 101) / 4.0).alias("cov"),
    )


SQL_CONTIG = "con AS (SELECT lang || '-' || source AS assembly, doc_id AS idx, n_chars AS len, (doc_id * 37 % 101) / 4.0 AS cov FROM documents)"


@query(
    "as1_clean_contigs",
    f"""WITH {SQL_CONTIG}, f AS (SELECT assembly, arg_min(cov, idx) AS fc FROM con GROUP BY 1)
    SELECT con.assembly, idx, len, CAST(cov AS DOUBLE) AS cov, cov >= fc * 0.4 AS kept FROM con JOIN f ON f.assembly = con.assembly WHERE len >= 500""",
)
def as1(spark, sf):
    kept, low = x.clean_contigs(contigs(spark, sf), share=0.4)
    return kept.withColumn("kept", F.lit(True)).unionByName(low.withColumn("kept", F.lit(False)))


@query(
    "as2_centre_slice",
    """SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, length(text) // 2 - 500 + 1, 1000) ELSE text END AS middle FROM documents""",
)
def as2(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", x.centre_slice(F.col("text")).alias("middle"))


def hits(spark, sf):
    """Search hits: genome = supplier modulo 40, contig = part modulo 25, species text from brand and type."""
    li = b.table(spark, sf, "lineitem").join(b.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(
        (F.col("l_suppkey") % 40).alias("genome"), (F.col("l_partkey") % 25).alias("contig"),
        F.concat("l_orderkey", F.lit("."), "l_linenumber", F.lit("."), "l_suppkey", F.lit("."), "l_partkey").alias("acc"),
        F.concat("p_type", F.lit(" "), "l_returnflag", F.lit(" strain "), "p_brand").alias("title"),
        F.col("l_extendedprice").alias("bitscore"), F.col("l_tax").alias("evalue"), F.col("l_quantity").alias("identity"),
    )


SQL_HITS = """hits AS (SELECT l_suppkey % 40 AS genome, l_partkey % 25 AS contig, l_orderkey || '.' || l_linenumber || '.' || l_suppkey || '.' || l_partkey AS acc,
   p_type || ' ' || l_returnflag AS species, l_extendedprice AS bitscore, l_tax AS evalue, l_quantity AS identity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_tax < 0.05)"""


@query(
    "as3_rank_hits",
    f"""WITH {SQL_HITS} SELECT genome, contig, bitscore, evalue, identity, species,
    row_number() OVER (PARTITION BY genome, contig ORDER BY bitscore DESC, evalue, identity DESC, acc) AS rank FROM hits""",
)
def as3(spark, sf):
    return x.rank_hits(hits(spark, sf)).drop("acc", "title")


@query(
    "as4_target_vs_other",
    f"""WITH {SQL_HITS}, h AS (SELECT *, CASE WHEN genome % 2 = 0 THEN 'PROMO A' ELSE 'NONE X' END AS target FROM hits),
    r AS (SELECT *, row_number() OVER (PARTITION BY genome, contig, species = target ORDER BY bitscore DESC, evalue, identity DESC, acc) AS k FROM h),
    t AS (SELECT * FROM r WHERE k = 1 AND species = target), o AS (SELECT * FROM r WHERE k = 1 AND species <> target)
    SELECT coalesce(t.genome, o.genome) AS genome, coalesce(t.contig, o.contig) AS contig, t.species AS species_target, t.identity AS identity_target,
      coalesce(o.species, 'NA') AS species_other, coalesce(o.identity, 0) AS identity_other,
      CASE WHEN o.identity IS NULL THEN 0 WHEN t.identity IS NULL THEN o.identity ELSE greatest(o.identity - t.identity, 0) END AS pident_diff
    FROM t FULL JOIN o ON o.genome = t.genome AND o.contig = t.contig""",
)
def as4(spark, sf):
    rows = hits(spark, sf)
    targets = rows.select("genome").distinct().withColumn(
        "target", F.when(F.col("genome") % 2 == 0, "PROMO A").otherwise("NONE X")
    )
    return x.target_vs_other(rows, targets)


@query(
    "as5_n50_l50",
    f"""WITH {SQL_CONTIG}, c AS (SELECT assembly, len, row_number() OVER w AS k, sum(len) OVER w AS cum, round_even(sum(len) OVER (PARTITION BY assembly) / 2, 0) AS half
      FROM con WINDOW w AS (PARTITION BY assembly ORDER BY len DESC, idx ROWS UNBOUNDED PRECEDING))
    SELECT assembly, arg_min(len, k) AS n50, min(k) AS l50 FROM c WHERE cum >= half GROUP BY 1""",
)
def as5(spark, sf):
    return x.n50_l50(contigs(spark, sf))


@query(
    "as6_weighted_cov",
    f"""WITH {SQL_CONTIG}, m AS (SELECT *, sum(len * cov) OVER p / sum(len) OVER p AS mu FROM con WHERE len > 500 WINDOW p AS (PARTITION BY assembly))
    SELECT assembly, round(any_value(mu), 6) AS mean_cov, round(sqrt(sum(len * (cov - mu) * (cov - mu)) / sum(len)), 6) AS sd_cov, count(*) AS n_contigs, max(len) AS max_len,
    round(avg(len), 6) AS mean_len, median(len) AS median_len FROM m GROUP BY 1""",
)
def as6(spark, sf):
    out = x.weighted_cov(contigs(spark, sf))
    return out.select("assembly", *[R(c, 6).alias(c) for c in ("mean_cov", "sd_cov")], "n_contigs", "max_len", R("mean_len", 6).alias("mean_len"), "median_len")


@query(
    "as7_merge_stats",
    """SELECT lang, source, count(*) AS n, NULL::BIGINT AS chars FROM documents GROUP BY 1, 2 UNION ALL SELECT lang, NULL, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY 1""",
)
def as7(spark, sf):
    docs = b.table(spark, sf, "documents")
    n = F.count(F.lit(1)).alias("n")
    return x.merge_stats([docs.groupBy("lang", "source").agg(n), docs.groupBy("lang").agg(n, F.sum("n_chars").alias("chars"))])
