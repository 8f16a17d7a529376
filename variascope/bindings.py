"""Domain tables derived from the driver's Parquet tables, so that operators run on whole real inputs.

Each binding is a projection or aggregation of a whole table; the SQL twins spell the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variascope.operators.annotate import ref_base_at

N_SITES = 40


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Read counts: sample = supplier, site = part key modulo 40, base from the line number, strand from the status."""
    li = table(spark, sf, "lineitem")
    allele = F.col("l_linenumber") % 4
    forward = F.col("l_linestatus") == "O"
    counts = [
        F.count_if((allele == i % 4) & (forward if i < 4 else ~forward)).alias(f"n{i}") for i in range(8)
    ]
    return li.groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % N_SITES).alias("p")).agg(
        *counts, F.max("l_quantity").alias("fq"), F.count_if(F.col("l_returnflag") == "R").alias("indel_n")
    )


SQL_CELLS = """cells AS (
  SELECT l_suppkey AS sample, l_partkey % 40 AS p,
    count(*) FILTER (l_linenumber % 4 = 0 AND l_linestatus = 'O') AS n0,
    count(*) FILTER (l_linenumber % 4 = 1 AND l_linestatus = 'O') AS n1,
    count(*) FILTER (l_linenumber % 4 = 2 AND l_linestatus = 'O') AS n2,
    count(*) FILTER (l_linenumber % 4 = 3 AND l_linestatus = 'O') AS n3,
    count(*) FILTER (l_linenumber % 4 = 0 AND l_linestatus <> 'O') AS n4,
    count(*) FILTER (l_linenumber % 4 = 1 AND l_linestatus <> 'O') AS n5,
    count(*) FILTER (l_linenumber % 4 = 2 AND l_linestatus <> 'O') AS n6,
    count(*) FILTER (l_linenumber % 4 = 3 AND l_linestatus <> 'O') AS n7,
    max(l_quantity) AS fq, count(*) FILTER (l_returnflag = 'R') AS indel_n
  FROM lineitem GROUP BY 1, 2),
alleles AS (
  SELECT l_suppkey AS sample, l_partkey % 40 AS p, l_linenumber % 4 AS a, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3),
ranked AS (
  SELECT sample, p, a, n, sum(n) OVER (PARTITION BY sample, p) AS depth,
    row_number() OVER (PARTITION BY sample, p ORDER BY n DESC, a DESC) AS rk
  FROM (SELECT c.sample, c.p, v.a, coalesce(x.n, 0) AS n
        FROM cells c CROSS JOIN (VALUES (0), (1), (2), (3)) v(a)
        LEFT JOIN alleles x ON x.sample = c.sample AND x.p = c.p AND x.a = v.a)),
majors AS (
  SELECT sample, p, CAST(max(depth) AS BIGINT) AS depth,
    max(CASE WHEN rk = 1 THEN a END) AS major_nt, max(CASE WHEN rk = 2 THEN a END) AS minor_nt,
    max(CASE WHEN rk = 1 THEN n END) * 1.0 / max(depth) AS major_af,
    max(CASE WHEN rk = 2 THEN n END) * 1.0 / max(depth) AS minor_af
  FROM ranked GROUP BY 1, 2)"""


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse coverage: sample = user, position = hour since 2024-01-01, cov = events in that hour."""
    ev = table(spark, sf, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3600000000))
    return ev.groupBy(F.col("user_id").alias("sample"), hour.cast("long").alias("p")).agg(
        F.count(F.lit(1)).alias("cov")
    )


N_HOURS = 720

SQL_COVERAGE = """cov AS (
  SELECT user_id AS sample, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000.0) AS BIGINT) AS p,
         count(*) AS cov FROM events GROUP BY 1, 2),
smp AS (SELECT DISTINCT sample FROM cov),
grid AS (SELECT s.sample, h.p, coalesce(c.cov, 0) AS cov
         FROM smp s CROSS JOIN (SELECT range AS p FROM range(720)) h
         LEFT JOIN cov c ON c.sample = s.sample AND c.p = h.p)"""


def genes(spark: SparkSession, sf: str) -> DataFrame:
    """Gene intervals: gene per part, start = key * 100, length = size * 3."""
    part = table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("gene"),
        (F.col("p_partkey") * 100).alias("start"),
        (F.col("p_partkey") * 100 + F.col("p_size") * 3).alias("end"),
        F.when(F.col("p_type").isin("STANDARD", "PROMO", "LARGE"), F.lit("CDS")).otherwise(F.lit("ncRNA")).alias("type"),
        F.when(F.col("p_size") % 2 == 0, F.lit(1)).otherwise(F.lit(-1)).alias("strand"),
        F.col("p_brand").alias("product"),
        F.col("p_name").alias("name"),
    )


SQL_GENES = """genes AS (
  SELECT p_partkey AS gene, p_partkey * 100 AS start, p_partkey * 100 + p_size * 3 AS "end",
    CASE WHEN p_type IN ('STANDARD', 'PROMO', 'LARGE') THEN 'CDS' ELSE 'ncRNA' END AS type,
    CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS strand, p_brand AS product, p_name AS name
  FROM part)"""


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct variant positions, spread over the span of the genes."""
    span = genes(spark, sf).agg(F.max("end")).scalar()
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * SITE_STEP % span).alias("p")).distinct()


SITE_STEP = 39_916_801
SQL_SPAN = "(SELECT max(p_partkey * 100 + p_size * 3) FROM part)"
SQL_SITES = f"sites AS (SELECT DISTINCT l_orderkey * {SITE_STEP} % {SQL_SPAN} AS p FROM lineitem)"


def genome_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct variant positions on a genome that is a little longer than all contigs together."""
    length = table(spark, sf, "documents").agg(F.sum("n_chars") + 1000).scalar()
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * SITE_STEP % length).alias("p")).distinct()


SQL_GENOME_SITES = f"sites AS (SELECT DISTINCT l_orderkey * {SITE_STEP} % (SELECT CAST(sum(n_chars) AS BIGINT) + 1000 FROM documents) AS p FROM lineitem)"


def order_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Dated intervals: start = order day number, end = start + key % 30 (exclusive), per customer."""
    orders = table(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return orders.select(
        F.col("o_custkey").alias("sample"),
        F.col("o_orderkey").alias("interval_id"),
        day.alias("start"),
        (day + F.col("o_orderkey") % 30).alias("end"),
    )


SQL_INTERVALS = """iv AS (
  SELECT o_custkey AS sample, o_orderkey AS interval_id,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS start,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + o_orderkey % 30 AS "end"
  FROM orders)"""


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Nucleotide strings from whole document texts: letters a-f, g-l, m-r, s-z become A, T, C, G.

    A string is made once: it goes through a generator, below which Spark does not move filters and columns that use it
    several times.
    """
    docs = table(spark, sf, "documents")
    mapped = F.translate(
        F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "AAAAAATTTTTTCCCCCCGGGGGGGG"
    )
    return docs.select("doc_id", "lang", "source", F.explode(F.array(F.regexp_replace(mapped, "[^ATCG]", ""))).alias("seq"))


SQL_SEQUENCES = """sequences AS (
  SELECT doc_id, lang, source, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz',
    'AAAAAATTTTTTCCCCCCGGGGGGGG'), '[^ATCG]', '', 'g') AS seq FROM documents)"""


def heap_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Binary heap tree on customer key + 1: parent = node div 2; the root has a NULL parent."""
    customer = table(spark, sf, "customer")
    node = F.col("c_custkey") + 1
    parent = F.floor(node / 2).cast("long")
    return customer.select(
        node.alias("child"),
        F.when(node > 1, parent).alias("parent"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("weight"),
        F.col("c_mktsegment").alias("segment"),
    )


SQL_TREE = """tree AS (
  SELECT c_custkey + 1 AS child, CASE WHEN c_custkey > 0 THEN (c_custkey + 1) // 2 END AS parent,
    c_nationkey AS nation, c_acctbal AS weight, c_mktsegment AS segment FROM customer)"""


N_NODE_SITES = 24


def node_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Base (A, T, C, G or N) of every tree node at 24 sites, a fixed arithmetic rule of node and site."""
    nodes = table(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("node"))
    rows = nodes.withColumn("site", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_NODE_SITES - 1).cast("long"))))
    pick = (F.floor(F.col("node") / (F.col("site") + 2)) * 7 + F.col("site") * 3 + F.floor(F.col("node") / 5)) % 23
    return rows.select(
        "node", "site", F.substring(F.lit("AAAAAATTTTTCCCCCCGGGGGN"), (pick + 1).cast("int"), F.lit(1)).alias("nt")
    )


SQL_NODE_CALLS = """node_calls AS (
  SELECT node, site, substr('AAAAAATTTTTCCCCCCGGGGGN', CAST((node // (site + 2) * 7 + site * 3 + node // 5) % 23 + 1 AS BIGINT), 1) AS nt
  FROM (SELECT c_custkey + 1 AS node FROM customer) CROSS JOIN (SELECT range AS site FROM range(24)))"""


def contig_genes(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    """Three overlapping genes on every document contig, scaled to its length; coding-strand sequences included."""
    docs = (sequences(spark, sf) if docs is None else docs).withColumn("len", F.length("seq").cast("long"))
    third, sixth, twelfth, quarter = (F.floor(F.col("len") / k) * 3 for k in (9, 6, 12, 4))
    zero = F.lit(0).cast("long")
    gene = F.explode(
        F.array(
            F.struct(F.lit(1).alias("k"), zero.alias("start"), sixth.alias("end"), F.lit(1).alias("strand"), F.lit("CDS").alias("type")),
            F.struct(F.lit(2).alias("k"), twelfth.alias("start"), quarter.alias("end"), F.lit(-1).alias("strand"), F.lit("CDS").alias("type")),
            F.struct(
                F.lit(3).alias("k"), (third + sixth).alias("start"), F.col("len").alias("end"), F.lit(1).alias("strand"),
                F.lit("ncRNA").alias("type"),
            ),
        )
    )
    rows = docs.select("doc_id", "seq", gene.alias("g")).select("doc_id", "seq", "g.*").where(F.col("end") > F.col("start"))
    piece = F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return rows.select(
        F.col("doc_id").alias("contig"),
        (F.col("doc_id") * 10 + F.col("k")).alias("gene"),
        "start",
        "end",
        "strand",
        "type",
        F.when(F.col("strand") == 1, piece).otherwise(F.reverse(F.translate(piece, "ATCG", "TAGC"))).alias("seq"),
    )


SQL_CONTIG_GENES = SQL_SEQUENCES + """,
dl AS (SELECT doc_id, seq, CAST(length(seq) AS BIGINT) AS len FROM sequences),
g0 AS (SELECT doc_id, seq, 1 AS k, 0 AS start, len // 6 * 3 AS "end", 1 AS strand, 'CDS' AS type FROM dl
  UNION ALL SELECT doc_id, seq, 2, len // 12 * 3, len // 4 * 3, -1, 'CDS' FROM dl
  UNION ALL SELECT doc_id, seq, 3, len // 9 * 3 + len // 6 * 3, len, 1, 'ncRNA' FROM dl),
cg AS (SELECT doc_id AS contig, doc_id * 10 + k AS gene, start, "end", strand, type,
  CASE WHEN strand = 1 THEN substr(seq, start + 1, "end" - start)
       ELSE reverse(translate(substr(seq, start + 1, "end" - start), 'ATCG', 'TAGC')) END AS seq
  FROM g0 WHERE "end" > start)"""


def contig_calls(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    """Calls on document contigs: contig = part key, position from the order key, one call per (site, sample)."""
    docs = sequences(spark, sf) if docs is None else docs
    docs = docs.select(F.col("doc_id").alias("contig"), "seq").where(F.length("seq") > 0)
    sizes = docs.select("contig", F.length("seq").alias("len"))
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    points = li.join(sizes, F.col("l_partkey") == F.col("contig")).select(
        "contig", (F.col("l_orderkey") * 37 % F.col("len")).alias("pos"), F.col("l_suppkey").alias("sample"),
        (F.col("l_linenumber") % 4).alias("call"),
    )
    return (
        ref_base_at(points, docs)
        .groupBy("contig", F.col("pos").alias("p"), "sample", "ref")
        .agg(F.min("call").alias("call"))
    )


SQL_CONTIG_CALLS = """cc AS (
  SELECT contig, p, sample, CAST(instr('ATCG', substr(seq, p + 1, 1)) - 1 AS INTEGER) AS ref, min(call) AS call FROM (
    SELECT l_partkey AS contig, l_orderkey * 37 % length(seq) AS p, l_suppkey AS sample, l_linenumber % 4 AS call, seq
    FROM lineitem JOIN sequences ON doc_id = l_partkey WHERE length(seq) > 0) GROUP BY 1, 2, 3, 4)"""
