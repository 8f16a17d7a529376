"""Queries over the call, filter and quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variascope import bindings as b
from variascope.bindings import SQL_CELLS
from variascope.operators import calls as c
from variascope.registry import query

R = F.round

# Filter thresholds that suit the depth of the bound tables.
LIMITS = dict(min_fq=30, min_af=0.3, min_strand=2, max_indel_share=0.5)

SQL_FLAGS = SQL_CELLS + """,
flags AS (
  SELECT c.*, m.depth, m.major_nt, m.major_af, m.minor_nt, m.minor_af,
    c.fq < 30 AS f1, m.major_af < 0.3 AS f2,
    (c.n0 + c.n1 + c.n2 + c.n3 < 2 OR c.n4 + c.n5 + c.n6 + c.n7 < 2) AS f3,
    c.indel_n > 0.5 * m.depth AS f4
  FROM cells c JOIN majors m ON m.sample = c.sample AND m.p = c.p),
calls AS (SELECT *, CASE WHEN NOT (f1 OR f2 OR f3 OR f4) THEN major_nt END AS call FROM flags),
ref AS (SELECT p, CAST(p % 4 AS INTEGER) AS ref_nt FROM (SELECT DISTINCT p FROM cells)),
allele_q AS (SELECT p, call, max(fq) AS q FROM calls WHERE call IS NOT NULL GROUP BY 1, 2),
quality AS (
  SELECT s.p, coalesce((SELECT max(least(x.q, y.q)) FROM allele_q x JOIN allele_q y
                        ON x.p = y.p AND x.call < y.call WHERE x.p = s.p), -1.0) AS mut_qual
  FROM (SELECT DISTINCT p FROM calls) s),
mutated AS (
  SELECT c.*, q.mut_qual, r.ref_nt,
    coalesce(c.call IS NOT NULL AND c.call <> r.ref_nt AND q.mut_qual >= 1, FALSE) AS mutated
  FROM calls c JOIN quality q ON q.p = c.p JOIN ref r ON r.p = c.p)"""


def majors(spark: SparkSession, sf: str) -> DataFrame:
    return c.major_minor_allele(b.cells(spark, sf))


def called(spark: SparkSession, sf: str) -> DataFrame:
    return c.cell_filter(majors(spark, sf), c.call_failures(**LIMITS))


def reference(calls: DataFrame) -> DataFrame:
    return calls.select("p").distinct().withColumn("ref_nt", (F.col("p") % 4).cast("int"))


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    calls = called(spark, sf)
    return c.has_mutation(calls, c.site_quality(calls), reference(calls))


@query(
    "ca1_major_minor_allele",
    f"""WITH {SQL_CELLS} SELECT sample, p, depth, round(major_af, 6) AS major_af, major_nt, minor_nt,
    round(minor_af, 6) AS minor_af FROM majors""",
)
def ca1(spark, sf):
    return majors(spark, sf).select(
        "sample", "p", "depth", R("major_af", 6).alias("major_af"), "major_nt", "minor_nt", R("minor_af", 6).alias("minor_af")
    )


@query(
    "ca2_mutant_af",
    f"""WITH {SQL_CELLS} SELECT sample, p,
    round(CASE WHEN major_nt <> p % 4 THEN major_af ELSE 0.0 END, 6) AS mutant_af FROM majors""",
)
def ca2(spark, sf):
    rows = majors(spark, sf).withColumn("ref_nt", (F.col("p") % 4).cast("int"))
    return c.mutant_af(rows).select("sample", "p", R("mutant_af", 6).alias("mutant_af"))


@query(
    "ca3_consensus_allele",
    f"""WITH {SQL_FLAGS}, votes AS (SELECT p, call, count(*) AS n FROM calls WHERE call IS NOT NULL GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, call) AS rk FROM votes)
    SELECT s.p, b.call AS consensus, b.n AS votes FROM (SELECT DISTINCT p FROM calls) s
    LEFT JOIN best b ON b.p = s.p AND b.rk = 1""",
)
def ca3(spark, sf):
    return c.consensus_allele(called(spark, sf))


@query(
    "ca4_choose_outgroup",
    f"""WITH {SQL_FLAGS}, outs AS (SELECT * FROM calls WHERE sample % 10 = 0),
    miss AS (SELECT sample, count(*) FILTER (call IS NULL) AS m FROM outs GROUP BY 1),
    best AS (SELECT sample FROM miss ORDER BY m, sample LIMIT 1),
    votes AS (SELECT p, call, count(*) AS n FROM outs WHERE call IS NOT NULL GROUP BY 1, 2),
    cons AS (SELECT p, call, row_number() OVER (PARTITION BY p ORDER BY n DESC, call) AS rk FROM votes)
    SELECT s.p, o.call AS best_call, k.call AS consensus, coalesce(o.call, k.call) AS anc
    FROM (SELECT DISTINCT p FROM calls) s LEFT JOIN cons k ON k.p = s.p AND k.rk = 1
    LEFT JOIN (SELECT * FROM outs WHERE sample IN (SELECT sample FROM best)) o ON o.p = s.p""",
)
def ca4(spark, sf):
    return c.choose_outgroup(called(spark, sf), outgroup=F.col("sample") % 10 == 0)


@query(
    "ca5_sample_filter",
    f"""WITH {SQL_CELLS}, st AS (SELECT sample, median(depth) AS m FROM majors GROUP BY 1)
    SELECT s_suppkey AS sample, s_nationkey FROM supplier WHERE s_suppkey IN (SELECT sample FROM st WHERE m >= 15)""",
)
def ca5(spark, sf):
    stats = majors(spark, sf).groupBy("sample").agg(F.percentile("depth", F.lit(0.5)).alias("median_cov"))
    samples = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample"), "s_nationkey")
    return c.sample_filter(samples, stats, min_median=15)


@query(
    "ca6_sample_select",
    """WITH keep AS (SELECT c_name AS sample, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING'
      AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')),
    outs AS (SELECT c_name AS sample, c_mktsegment AS segment FROM customer WHERE regexp_matches(c_name, '00$'))
    SELECT sample, segment, FALSE AS is_outgroup, lpad(CAST(CAST(regexp_extract(sample, '\\d+') AS BIGINT) AS VARCHAR), 6, '0') AS padded FROM keep
    UNION ALL
    SELECT sample, segment, TRUE, lpad(CAST(CAST(regexp_extract(sample, '\\d+') AS BIGINT) AS VARCHAR), 6, '0') FROM outs
    WHERE sample NOT IN (SELECT sample FROM keep)""",
)
def ca6(spark, sf):
    customer = b.table(spark, sf, "customer")
    orders = b.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    excluded = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_name").alias("sample"))
    samples = customer.select(F.col("c_name").alias("sample"), F.col("c_mktsegment").alias("segment"))
    return c.sample_select(samples, subject=F.col("segment") == "BUILDING", excluded=excluded, outgroup_pattern="00$")


@query("ca7_cell_filter", f"WITH {SQL_FLAGS} SELECT sample, p, call FROM calls")
def ca7(spark, sf):
    return called(spark, sf).select("sample", "p", "call")


@query(
    "ca8_filter_loss_report",
    f"""WITH {SQL_FLAGS} SELECT sample, count(*) AS calls,
    round(count(*) FILTER (f1) * 100.0 / count(*), 6) AS pct_low_fq, round(count(*) FILTER (f2) * 100.0 / count(*), 6) AS pct_low_af,
    round(count(*) FILTER (f3) * 100.0 / count(*), 6) AS pct_low_cov, round(count(*) FILTER (f4) * 100.0 / count(*), 6) AS pct_indel
    FROM calls GROUP BY 1""",
)
def ca8(spark, sf):
    report = c.filter_loss_report(majors(spark, sf), c.call_failures(**LIMITS))
    return report.select("sample", "calls", *[R(x, 6).alias(x) for x in report.columns[2:]])


@query(
    "ca9_site_filter",
    f"""WITH {SQL_FLAGS} SELECT p, count(*) FILTER (call IS NULL) AS n_missing, count(*) AS n_samples,
    coalesce(median(CASE WHEN depth > 0 THEN depth END), -1.0) AS median_cov FROM calls GROUP BY 1
    HAVING count(*) FILTER (call IS NULL) < count(*) * 0.45 AND coalesce(median(CASE WHEN depth > 0 THEN depth END), -1.0) >= 14""",
)
def ca9(spark, sf):
    return c.site_filter(called(spark, sf), max_ambiguous=0.45, min_median=14)


@query(
    "ca10_site_quality",
    f"""WITH {SQL_FLAGS}, pairs AS (
      SELECT x.p, max(least(x.fq, y.fq)) AS q FROM calls x JOIN calls y
      ON x.p = y.p AND x.sample < y.sample AND x.call <> y.call GROUP BY 1)
    SELECT s.p, coalesce(q, -1.0) AS mut_qual FROM (SELECT DISTINCT p FROM calls) s LEFT JOIN pairs ON pairs.p = s.p""",
)
def ca10(spark, sf):
    return c.site_quality(called(spark, sf)).select("p", "mut_qual")


@query("ca11_has_mutation", f"WITH {SQL_FLAGS} SELECT sample, p, mut_qual, mutated FROM mutated")
def ca11(spark, sf):
    return flagged(spark, sf).select("sample", "p", "mut_qual", "mutated")


@query("ca12_candidate_sites", f"WITH {SQL_FLAGS} SELECT p, count(*) AS n_mutated FROM mutated WHERE mutated GROUP BY 1")
def ca12(spark, sf):
    return c.candidate_sites(flagged(spark, sf))


@query(
    "ca13_burden_tables",
    f"""WITH {SQL_FLAGS} SELECT sample, NULL AS p, count(*) FILTER (mutated) AS n_mutated FROM mutated GROUP BY sample
    UNION ALL SELECT NULL, p, count(*) FILTER (mutated) FROM mutated GROUP BY p""",
)
def ca13(spark, sf):
    return c.burden_tables(flagged(spark, sf))


@query(
    "ca14_filter_combinations",
    f"""WITH {SQL_FLAGS}, sub AS (SELECT CAST(range AS INTEGER) AS subset FROM range(1, 16)),
    hit AS (SELECT m.p, s.subset, bool_and(NOT m.major_nt <> r.ref_nt OR (s.subset & 1 > 0 AND m.f1) OR (s.subset & 2 > 0 AND m.f2)
        OR (s.subset & 4 > 0 AND m.f3) OR (s.subset & 8 > 0 AND m.f4)) AS lost
      FROM flags m JOIN ref r ON r.p = m.p CROSS JOIN sub s GROUP BY 1, 2)
    SELECT subset, count(*) FILTER (lost) AS n_sites FROM hit GROUP BY 1""",
)
def ca14(spark, sf):
    rows = majors(spark, sf).withColumn("ref_nt", (F.col("p") % 4).cast("int"))
    return c.filter_combinations_within(
        rows, list(c.call_failures(**LIMITS).values()), base=~(F.col("major_nt") != F.col("ref_nt"))
    )


@query(
    "ca14_filter_combinations_across",
    """WITH f AS (SELECT l_quantity < 10 AS f1, l_discount > 0.08 AS f2, l_tax < 0.02 AS f3, l_returnflag = 'R' AS f4 FROM lineitem),
    sub AS (SELECT CAST(range AS INTEGER) AS subset FROM range(1, 16))
    SELECT subset, count(*) FILTER ((subset & 1 > 0 AND f1) OR (subset & 2 > 0 AND f2) OR (subset & 4 > 0 AND f3)
      OR (subset & 8 > 0 AND f4)) AS n_sites FROM f CROSS JOIN sub GROUP BY 1""",
)
def ca14_across(spark, sf):
    li = b.table(spark, sf, "lineitem")
    masks = [F.col("l_quantity") < 10, F.col("l_discount") > 0.08, F.col("l_tax") < 0.02, F.col("l_returnflag") == "R"]
    return c.filter_combinations_across(li, masks)


def indel_rows(spark, sf):
    li = b.table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_partkey")).alias("p"), (F.col("l_suppkey") % 25).alias("sample")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("dp_alt"),
        F.count_if(F.col("l_returnflag") != "A").alias("dp_ref"),
        F.count(F.lit(1)).alias("dp"),
        F.min(-F.col("l_quantity")).alias("gl_ref"),
        F.max(-F.col("l_discount")).alias("gl_alt"),
        (F.max("l_linenumber") - F.min("l_linenumber") - 1).alias("size"),
    )


SQL_INDELS = """ind AS (SELECT l_partkey AS p, l_suppkey % 25 AS sample, count(*) FILTER (l_returnflag = 'A') AS dp_alt,
  count(*) FILTER (l_returnflag <> 'A') AS dp_ref, count(*) AS dp, min(-l_quantity) AS gl_ref, max(-l_discount) AS gl_alt,
  max(l_linenumber) - min(l_linenumber) - 1 AS size FROM lineitem GROUP BY 1, 2),
flagged AS (SELECT *, dp >= 2 AND size <> 0 AND dp_alt * 1.0 / dp > 0.8 AND gl_ref - gl_alt <= -10 AS has_indel,
  dp >= 2 AND dp_ref * 1.0 / dp > 0.8 AS has_ref,
  dp >= 2 AND dp_alt * 1.0 / dp <= 0.8 AND dp_ref * 1.0 / dp <= 0.8 AS mid FROM ind),
good AS (SELECT p FROM flagged GROUP BY p HAVING count(*) FILTER (mid) < count(*) * 0.2
  AND count(*) FILTER (has_indel) > 0 AND count(*) FILTER (has_ref) > 0)"""


@query(
    "ca15_indel_filter",
    f"WITH {SQL_INDELS} SELECT p, sample, dp, size, has_indel, has_ref FROM flagged WHERE p IN (SELECT p FROM good)",
)
def ca15(spark, sf):
    return c.indel_filter(indel_rows(spark, sf), min_cov=2).select("p", "sample", "dp", "size", "has_indel", "has_ref")


@query(
    "ca16_best_alternate",
    """WITH e AS (SELECT vec_id, label, unnest(embedding[2:]) AS g, generate_subscripts(embedding[2:], 1) AS i FROM embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY g DESC, i DESC) AS rk FROM e)
    SELECT vec_id, CAST(i AS INTEGER) AS alt_idx, round(CAST(g AS DOUBLE), 6) AS gl_alt FROM r WHERE rk = 1""",
)
def ca16(spark, sf):
    rows = c.best_alternate(b.table(spark, sf, "embeddings"), "embedding")
    return rows.select("vec_id", "alt_idx", R(F.col("gl_alt").cast("double"), 6).alias("gl_alt"))


@query(
    "ca17_indel_call_matrix",
    f"""WITH {SQL_INDELS} SELECT p, sample, CASE WHEN has_indel THEN 'alt' || size WHEN has_ref THEN 'ref' ELSE '?' END AS call
    FROM flagged WHERE p IN (SELECT p FROM good)""",
)
def ca17(spark, sf):
    kept = c.indel_filter(indel_rows(spark, sf), min_cov=2)
    alt = F.concat(F.lit("alt"), F.col("size"))
    return kept.select("p", "sample", c.indel_call(F.col("has_indel"), F.col("has_ref"), alt, F.lit("ref")).alias("call"))


@query(
    "ca18_binned_quality_rates",
    f"""WITH {SQL_FLAGS} SELECT sample, count(*) AS n,
    round(count(*) FILTER (minor_af >= 0 AND minor_af < 0.25) * 1.0 / count(*), 6) AS bin0,
    round(count(*) FILTER (minor_af >= 0.25 AND minor_af < 0.3) * 1.0 / count(*), 6) AS bin1,
    round(count(*) FILTER (minor_af >= 0.3) * 1.0 / count(*), 6) AS bin2 FROM mutated WHERE mutated GROUP BY 1""",
)
def ca18(spark, sf):
    rates = c.binned_quality_rates(flagged(spark, sf), F.col("minor_af"), [0, 0.25, 0.3])
    return rates.select("sample", "n", *[R(x, 6).alias(x) for x in ("bin0", "bin1", "bin2")])


@query(
    "ca18_frame_rates",
    f"""WITH {SQL_FLAGS} SELECT sample, p // 8 AS frame, count(*) FILTER (mutated) AS hits, count(*) AS sites,
    round(count(*) FILTER (mutated) * 1.0 / count(*), 6) AS share FROM mutated GROUP BY 1, 2""",
)
def ca18_frames(spark, sf):
    return c.frame_rates(flagged(spark, sf), frame=8).withColumn("share", R("share", 6))


@query(
    "ca19_strand_depth_table",
    f"""WITH {SQL_CELLS} SELECT p, sample, substr('ATCG', CAST(a + 1 AS BIGINT), 1) AS base, strand, n AS reads FROM (
    SELECT p, sample, 0 AS a, 'fwd' AS strand, n0 AS n FROM cells UNION ALL SELECT p, sample, 1, 'fwd', n1 FROM cells
    UNION ALL SELECT p, sample, 2, 'fwd', n2 FROM cells UNION ALL SELECT p, sample, 3, 'fwd', n3 FROM cells
    UNION ALL SELECT p, sample, 0, 'rev', n4 FROM cells UNION ALL SELECT p, sample, 1, 'rev', n5 FROM cells
    UNION ALL SELECT p, sample, 2, 'rev', n6 FROM cells UNION ALL SELECT p, sample, 3, 'rev', n7 FROM cells)""",
)
def ca19(spark, sf):
    return c.strand_depth_table(b.cells(spark, sf))


@query(
    "ca20_polarization_report",
    f"""WITH {SQL_FLAGS}, outs AS (SELECT * FROM calls WHERE sample % 10 = 0),
    per AS (SELECT sample, count(*) FILTER (call IS NULL) AS unresolved, count(*) AS sites FROM outs GROUP BY 1),
    comb AS (SELECT count(*) FILTER (c IS NULL) AS unresolved, count(*) AS sites FROM (SELECT p, max(call) AS c FROM outs GROUP BY 1))
    SELECT sample, unresolved, sites, round(1 - unresolved * 1.0 / sites, 6) AS resolved_share FROM
      (SELECT * FROM per UNION ALL SELECT NULL, unresolved, sites FROM comb)""",
)
def ca20(spark, sf):
    report = c.polarization_report(called(spark, sf), outgroup=F.col("sample") % 10 == 0)
    return report.withColumn("resolved_share", R("resolved_share", 6))
