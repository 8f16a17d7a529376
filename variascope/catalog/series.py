"""Queries over clock tables and frequency series."""

from __future__ import annotations

from pyspark.sql import functions as F

from variascope import bindings as b
from variascope.catalog import distributions as dist
from variascope.operators import clock as c
from variascope.operators import series as s
from variascope.registry import query

R = F.round

SQL_ISOLATES = """iso AS (SELECT o_custkey % 50 AS subject, o_orderkey AS isolate, CAST(o_orderdate AS DATE) AS day, DATE '1994-12-01' + CAST(o_custkey % 50 AS INTEGER) AS admission,
  (SELECT 1) * coalesce(n, 0) AS n_mut, 1000 + o_orderkey % 100 AS callable, o_orderstatus <> 'P' AS routine
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
first AS (SELECT subject, min(day) AS f FROM iso WHERE routine GROUP BY 1),
clock AS (SELECT iso.subject, isolate, CAST(date_diff('day', f, day) AS BIGINT) AS days_since_first, CAST(date_diff('day', admission, day) AS BIGINT) AS days_since_admission, n_mut, callable,
  n_mut * 1.0::DOUBLE / callable AS rate FROM iso JOIN first ON first.subject = iso.subject WHERE routine)"""


def isolates(spark, sf):
    muts = b.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = b.table(spark, sf, "orders").join(muts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    subject = F.col("o_custkey") % 50
    return orders.select(
        subject.alias("subject"), F.col("o_orderkey").alias("isolate"), F.col("o_orderdate").cast("date").alias("day"),
        F.date_add(F.lit("1994-12-01").cast("date"), subject.cast("int")).alias("admission"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_mut"), (1000 + F.col("o_orderkey") % 100).alias("callable"),
        (F.col("o_orderstatus") != "P").alias("routine"),
    )


def clock(spark, sf):
    return c.clock_table(isolates(spark, sf), routine_only=True)


@query("cl1_clock_table", f"WITH {SQL_ISOLATES} SELECT subject, isolate, days_since_first, days_since_admission, n_mut, callable, round(rate, 6) AS rate FROM clock")
def cl1(spark, sf):
    return clock(spark, sf).withColumn("rate", R("rate", 6))


@query(
    "cl1_mean_rate_by_day",
    f"WITH {SQL_ISOLATES} SELECT subject, days_since_first, count(*) AS n, round(avg(rate), 6) AS mean_rate FROM clock GROUP BY 1, 2",
)
def cl1_day(spark, sf):
    return c.mean_rate_by_day(clock(spark, sf)).withColumn("mean_rate", R("mean_rate", 6))


@query(
    "cl2_linear_fit",
    f"""WITH {SQL_ISOLATES} SELECT subject, count(*) AS n, round(regr_slope(rate, days_since_first) * 1e6, 6) AS slope, round(regr_intercept(rate, days_since_first), 6) AS intercept,
    round(regr_r2(rate, days_since_first), 6) AS r2, round(sqrt((regr_syy(rate, days_since_first) - regr_slope(rate, days_since_first) * regr_sxy(rate, days_since_first)) / (count(*) - 2) / regr_sxx(rate, days_since_first)) * 1e6, 6) AS stderr,
    round(regr_slope(rate, days_since_first) * 365 * 1e6, 4) AS rate FROM clock GROUP BY 1""",
)
def cl2(spark, sf):
    fit = c.linear_fit(clock(spark, sf), x="days_since_first", y="rate", by=["subject"])
    return fit.select(
        "subject", "n", R(F.col("slope") * 1e6, 6).alias("slope"), R("intercept", 6).alias("intercept"), R("r2", 6).alias("r2"),
        R(F.col("stderr") * 1e6, 6).alias("stderr"), R("rate", 4).alias("rate"),
    )


@query(
    "cl2_linear_fit_interval",
    f"""WITH RECURSIVE {SQL_ISOLATES}, ft AS (SELECT subject, count(*) - 2 AS df, regr_slope(rate, days_since_first) AS slope,
      sqrt(greatest(regr_syy(rate, days_since_first) - regr_slope(rate, days_since_first) * regr_sxy(rate, days_since_first), 0) / (count(*) - 2) / regr_sxx(rate, days_since_first)) AS se FROM clock GROUP BY 1 HAVING count(*) > 2),
    tv AS (SELECT *, slope / se AS t FROM ft), {dist.t_quantiles("ft", 0.05)}
    SELECT subject, round({dist.t_two_sided("t", "tv.df")}, 6) AS p_value, round((slope - q * se) * 365 * 1e6, 4) AS rate_low, round((slope + q * se) * 365 * 1e6, 4) AS rate_high FROM tv JOIN tq ON tq.df = tv.df""",
)
def cl2_interval(spark, sf):
    fit = c.linear_fit(clock(spark, sf), x="days_since_first", y="rate", by=["subject"])
    return fit.where("n > 2").select("subject", R("p_value", 6).alias("p_value"), R("rate_low", 4).alias("rate_low"), R("rate_high", 4).alias("rate_high"))


@query(
    "cl3_tmrca_point",
    f"""WITH {SQL_ISOLATES} SELECT subject, days_since_first // 365 AS time, count(*) AS n, round(avg(rate), 8) AS mean, round(avg(rate) * 365 * 1e6 / 2.5e6, 4) AS age,
    round(min(days_since_admission) - avg(rate) * 365 * 1e6 / 2.5e6, 4) AS before_admission FROM clock GROUP BY 1, 2 HAVING count(*) >= 10""",
)
def cl3(spark, sf):
    return tmrca(spark, sf).select(
        "subject", "time", "n", R("mean", 8).alias("mean"), R("age", 4).alias("age"), R("before_admission", 4).alias("before_admission")
    )


@query(
    "cl3_tmrca_interval",
    f"""WITH RECURSIVE {SQL_ISOLATES}, ms AS (SELECT subject, days_since_first // 365 AS time, count(*) - 1 AS df, avg(rate) AS m, stddev_samp(rate) / sqrt(count(*)) AS se FROM clock GROUP BY 1, 2 HAVING count(*) >= 10),
    {dist.t_quantiles("ms", 0.05)}
    SELECT subject, time, round(m - q * se, 8) AS mean_low, round(m + q * se, 8) AS mean_high, round((m - q * se) * 146, 4) AS age_low, round((m + q * se) * 146, 4) AS age_high FROM ms JOIN tq ON tq.df = ms.df""",
)
def cl3_interval(spark, sf):
    return tmrca(spark, sf).select(
        "subject", "time", R("mean_low", 8).alias("mean_low"), R("mean_high", 8).alias("mean_high"), R("age_low", 4).alias("age_low"), R("age_high", 4).alias("age_high")
    )


def tmrca(spark, sf):
    rows = clock(spark, sf).select(
        "subject", F.floor(F.col("days_since_first") / 365).alias("time"), F.col("rate").alias("per_base"),
        F.col("days_since_admission").alias("days_in_hospital"),
    )
    return c.tmrca_point(rows, rate=F.lit(2.5e6))


# ---- frequency series ----

SQL_FREQ = """cl AS (SELECT l_linenumber AS mutation, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'R' END AS allele, l_orderkey AS sample, year(o_orderdate) AS time, o_orderpriority AS location,
  CASE WHEN l_tax > 0.01 THEN l_returnflag END AS call FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
fq AS (SELECT mutation, allele, time, location, CASE WHEN count(call) > 0 THEN count(*) FILTER (call = allele) * 1.0::DOUBLE / count(call) ELSE 0 END AS freq, count(*) AS n
  FROM cl GROUP BY GROUPING SETS ((mutation, allele, time, location), (mutation, allele, time)))"""


def calls(spark, sf):
    li = b.table(spark, sf, "lineitem").join(b.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(
        F.col("l_linenumber").alias("mutation"), F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("R").alias("allele"),
        F.col("l_orderkey").alias("sample"), F.year("o_orderdate").cast("long").alias("time"), F.col("o_orderpriority").alias("location"),
        F.when(F.col("l_tax") > 0.01, F.col("l_returnflag")).alias("call"),
    )


@query("af1_allele_freq", f"WITH {SQL_FREQ} SELECT mutation, allele, time, location, round(freq, 6) AS freq, n FROM fq")
def af1(spark, sf):
    return s.allele_freq(calls(spark, sf)).withColumn("freq", R("freq", 6))


@query(
    "af2_freq_shift",
    f"""WITH cl AS (SELECT l_partkey % 500 AS mutation, 'A' AS allele, year(l_shipdate) AS time, CASE WHEN l_tax > 0.01 THEN l_returnflag END AS call FROM lineitem),
    f AS (SELECT mutation, allele, time, coalesce(count(*) FILTER (call = allele) * 1.0::DOUBLE / nullif(count(call), 0), 0) AS freq, count(*) AS n FROM cl GROUP BY 1, 2, 3),
    sh AS (SELECT mutation, max(freq) - min(freq) AS shift FROM f WHERE n >= 2 GROUP BY 1 HAVING count(*) > 1),
    ca AS (SELECT mutation, call, count(*) AS n FROM cl WHERE call IS NOT NULL GROUP BY 1, 2), mi AS (SELECT mutation, sum(n) FILTER (n <> t) AS minor FROM
      (SELECT *, max(n) OVER (PARTITION BY mutation) AS t FROM ca) GROUP BY 1)
    SELECT sh.mutation, round(shift, 6) AS shift FROM sh JOIN mi ON mi.mutation = sh.mutation WHERE coalesce(minor, 0) <> 1 AND shift >= 0.3""",
)
def af2(spark, sf):
    li = b.table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 500).alias("mutation"), F.lit("A").alias("allele"), F.year("l_shipdate").alias("time"),
        F.lit("all").alias("location"), F.when(F.col("l_tax") > 0.01, F.col("l_returnflag")).alias("call"),
    )
    pooled = s.allele_freq(li).where(F.col("location").isNull())
    carriers = li.where("call IS NOT NULL").groupBy("mutation", "call").agg(F.count(F.lit(1)).alias("n"))
    return s.freq_shift(pooled, carriers).withColumn("shift", R("shift", 6))


YEARS = list(range(1995, 2002))


@query(
    "af3_long_to_wide",
    f"WITH {SQL_FREQ} SELECT mutation, location, " + ", ".join(f'round(max(freq) FILTER (time = {y}), 6) AS "{y}"' for y in YEARS)
    + " FROM fq WHERE location IS NOT NULL GROUP BY 1, 2",
)
def af3(spark, sf):
    wide = s.long_to_wide(s.allele_freq(calls(spark, sf)).where(F.col("location").isNotNull()), times=YEARS)
    return wide.select("mutation", "location", *[R(F.col(str(y)), 6).alias(str(y)) for y in YEARS])


@query(
    "af3_unpivot_samples",
    """WITH u AS (SELECT o_orderkey AS site, 's1' AS sample, CASE WHEN o_custkey % 3 = 0 THEN '?' ELSE o_orderstatus END AS call FROM orders
    UNION ALL SELECT o_orderkey, 's2', left(o_orderpriority, 1) FROM orders) SELECT site, sample, nullif(call, '?') AS call FROM u""",
)
def af3_unpivot(spark, sf):
    wide = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("site"), F.when(F.col("o_custkey") % 3 == 0, "?").otherwise(F.col("o_orderstatus")).alias("s1"),
        F.substring("o_orderpriority", 1, 1).alias("s2"),
    )
    return s.unpivot_samples(wide, ids=["site"], samples=["s1", "s2"])


@query(
    "af3_explode_alleles",
    """WITH t AS (SELECT o_orderkey AS site, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_suppkey, l_partkey) AS al, string_agg('m' || l_linenumber, ', ' ORDER BY l_linenumber, l_suppkey, l_partkey) AS lb
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT site, unnest(str_split(al, '')) AS allele, unnest(str_split(lb, ', ')) AS label FROM t""",
)
def af3_alleles(spark, sf):
    li = b.table(spark, sf, "lineitem").join(b.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")))
    rows = li.groupBy(F.col("o_orderkey").alias("site")).agg(listed.alias("x")).select(
        "site", F.array_join(F.transform("x", lambda v: v["l_returnflag"]), "").alias("al"),
        F.array_join(F.transform("x", lambda v: F.concat(F.lit("m"), v["l_linenumber"])), ", ").alias("lb"),
    )
    return s.explode_alleles(rows, alleles="al", labels="lb")


@query(
    "af4_untie_times",
    """WITH m AS (SELECT o_custkey, o_orderkey, CAST(month(o_orderdate) AS DOUBLE) AS t FROM orders)
    SELECT o_orderkey, round(t + 0.1 * (row_number() OVER (PARTITION BY o_custkey, t ORDER BY o_orderkey) - 1), 6) AS untied FROM m""",
)
def af4(spark, sf):
    rows = b.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.month("o_orderdate").cast("double").alias("t"))
    return s.untie_times(rows, keys=["o_custkey"], time="t", order="o_orderkey").select("o_orderkey", R("untied", 6).alias("untied"))


SQL_KNOTS = """kn AS (SELECT c_mktsegment AS mutation, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS DOUBLE) AS t,
  count(*) FILTER (o_orderpriority = '1-URGENT') * 1.0::DOUBLE / count(*) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""
POINTS = 200
SQL_GRID = SQL_KNOTS + f""",
a1 AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY mutation) AS n, lead(t) OVER w - t AS h, (lead(v) OVER w - v) / (lead(t) OVER w - t) AS d,
   min(t) OVER (PARTITION BY mutation) AS t0, max(t) OVER (PARTITION BY mutation) - 1 AS t1 FROM kn WINDOW w AS (PARTITION BY mutation ORDER BY t)),
a2 AS (SELECT *, lag(h) OVER w AS hp, lag(d) OVER w AS dp, lead(h) OVER w AS hn, lead(d) OVER w AS dn, lag(h, 2) OVER w AS hq, lag(d, 2) OVER w AS dq FROM a1 WINDOW w AS (PARTITION BY mutation ORDER BY t)),
a3 AS (SELECT *, CASE WHEN i = 1 THEN ((2 * h + hn) * d - h * dn) / (h + hn) WHEN i = n THEN ((2 * hp + hq) * dp - hp * dq) / (hp + hq) END AS e,
   CASE WHEN i = 1 THEN d WHEN i = n THEN dp END AS e0, CASE WHEN i = 1 THEN dn WHEN i = n THEN dq END AS e1 FROM a2),
a4 AS (SELECT *, CASE WHEN i = 1 OR i = n THEN CASE WHEN sign(e) <> sign(e0) THEN 0 WHEN sign(e0) <> sign(e1) AND abs(e) > 3 * abs(e0) THEN 3 * e0 ELSE e END
   WHEN dp * d <= 0 THEN 0 ELSE (3 * h + 3 * hp) / ((2 * h + hp) / dp + (h + 2 * hp) / d) END AS m FROM a3),
gx AS (SELECT DISTINCT mutation, g.range AS g, t0 + g.range * (t1 - t0) / {POINTS - 1} AS x FROM a4, range({POINTS}) g),
ev AS (SELECT gx.mutation, gx.g, gx.x, a4.t, a4.v, a4.h, a4.m, a4.d FROM gx ASOF JOIN a4 ON a4.mutation = gx.mutation AND gx.x + 1e-9 >= a4.t),
nx AS (SELECT mutation, t, lead(v) OVER w AS v1, lead(m) OVER w AS m1 FROM a4 WINDOW w AS (PARTITION BY mutation ORDER BY t)),
grd AS (SELECT ev.mutation, CAST(g AS INTEGER) AS g, x, greatest(0, (2*u*u*u - 3*u*u + 1) * v + (u*u*u - 2*u*u + u) * h * m + (3*u*u - 2*u*u*u) * v1 + (u*u*u - u*u) * h * m1) AS value
   FROM (SELECT ev.*, v1, m1, (x - ev.t) / h AS u FROM ev JOIN nx ON nx.mutation = ev.mutation AND nx.t = ev.t) ev)"""


def knots(spark, sf):
    o = b.table(spark, sf, "orders").join(
        b.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")
    )
    t = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("double")
    return o.groupBy(F.col("c_mktsegment").alias("mutation"), t.alias("t")).agg(
        (F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count(F.lit(1))).alias("v")
    )


@query("af5_interp_grid", f"WITH {SQL_GRID} SELECT mutation, g, round(x, 6) AS x, round(value, 6) AS value FROM grd")
def af5(spark, sf):
    grid = s.interp_grid(knots(spark, sf), keys=["mutation"], points=POINTS)
    return grid.select("mutation", "g", R("x", 6).alias("x"), R("value", 6).alias("value"))


# The same curve through logarithms of the shares.
SQL_SHARE = "count(*) FILTER (o_orderpriority = '1-URGENT') * 1.0::DOUBLE / count(*)"
SQL_GRID_LOG = (
    SQL_GRID.replace(f"{SQL_SHARE} AS v", f"ln({SQL_SHARE} + 1e-6) AS v").replace("greatest(0, (2*u", "greatest(0, exp((2*u").replace("h * m1) AS value", "h * m1)) AS value")
)


@query("af5_interp_grid_log", f"WITH {SQL_GRID_LOG} SELECT mutation, g, round(x, 6) AS x, round(value, 6) AS value FROM grd")
def af5_log(spark, sf):
    grid = s.interp_grid(knots(spark, sf), keys=["mutation"], points=POINTS, log_space=True)
    return grid.select("mutation", "g", R("x", 6).alias("x"), R("value", 6).alias("value"))


PARENTS = [("1-URGENT", "root"), ("2-HIGH", "root"), ("3-MEDIUM", "1-URGENT"), ("4-NOT SPECIFIED", "1-URGENT"), ("5-LOW", "3-MEDIUM")]


def month_shares(spark, sf):
    """Monthly share of every priority (0 where a month has none) and the root at 1."""
    o = b.table(spark, sf, "orders")
    g = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    names = [p for p, _ in PARENTS]
    wide = o.groupBy(g.alias("g")).agg(
        F.lit(1.0).alias("root"), *[(F.count_if(F.col("o_orderpriority") == p) / F.count(F.lit(1))).alias(p) for p in names]
    )
    return wide.unpivot(["g"], ["root", *[f"`{p}`" for p in names]], "mutation", "value").select("mutation", "g", "value")


def nested(spark, sf):
    parents = spark.createDataFrame(PARENTS, "mutation string, parent string")
    return s.nested_share(month_shares(spark, sf), parents)


SQL_NESTED = """WITH r AS (SELECT (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS g, o_orderpriority AS p, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1) AS v FROM orders GROUP BY 1, 2),
    w AS (SELECT g, coalesce(max(v) FILTER (p = '1-URGENT'), 0) AS u, coalesce(max(v) FILTER (p = '2-HIGH'), 0) AS h, coalesce(max(v) FILTER (p = '3-MEDIUM'), 0) AS m, coalesce(max(v) FILTER (p = '4-NOT SPECIFIED'), 0) AS n,
      coalesce(max(v) FILTER (p = '5-LOW'), 0) AS l FROM r GROUP BY 1),
    a AS (SELECT *, coalesce(1 / nullif(greatest(1 - u - h, 0) + u + h, 0), 0) AS f1 FROM w), b AS (SELECT *, u * f1 AS us, h * f1 AS hs FROM a),
    c AS (SELECT *, coalesce(us / nullif(greatest(us - m - n, 0) + m + n, 0), 0) AS f2 FROM b), d AS (SELECT *, m * f2 AS ms, n * f2 AS ns FROM c), e AS (SELECT *, coalesce(ms / nullif(greatest(ms - l, 0) + l, 0), 0) AS f3 FROM d)
    SELECT 'root' AS mutation, CAST(g AS INTEGER) AS g, round(greatest(1 - u - h, 0) * f1, 6) AS share FROM e UNION ALL SELECT '1-URGENT', CAST(g AS INTEGER), round(greatest(us - m - n, 0) * f2, 6) FROM e
    UNION ALL SELECT '2-HIGH', CAST(g AS INTEGER), round(hs, 6) FROM e UNION ALL SELECT '3-MEDIUM', CAST(g AS INTEGER), round(greatest(ms - l, 0) * f3, 6) FROM e
    UNION ALL SELECT '4-NOT SPECIFIED', CAST(g AS INTEGER), round(ns, 6) FROM e UNION ALL SELECT '5-LOW', CAST(g AS INTEGER), round(l * f3, 6) FROM e"""


@query("af6_nested_share", SQL_NESTED)
def af6(spark, sf):
    return nested(spark, sf).select("mutation", "g", R("share", 6).alias("share"))


@query(
    "af7_fit_check",
    f"""WITH {SQL_GRID}, pr AS (SELECT kn.mutation, kn.t, kn.v, value, row_number() OVER (PARTITION BY kn.mutation, kn.t ORDER BY round(abs(x - kn.t), 9), g) AS r FROM kn JOIN grd ON grd.mutation = kn.mutation)
    SELECT mutation, t, round(v, 6) AS obs, round(value, 6) AS est, round(v - value, 6) AS diff FROM pr WHERE r = 1""",
)
def af7(spark, sf):
    k = knots(spark, sf)
    out = s.fit_check(k, s.interp_grid(k, keys=["mutation"], points=POINTS))
    return out.select("mutation", "t", *[R(x, 6).alias(x) for x in ("obs", "est", "diff")])


@query(
    "af8_count_table",
    f"WITH {SQL_FREQ} SELECT location, time, arg_min(n, mutation) AS cnts FROM fq GROUP BY 1, 2",
)
def af8_counts(spark, sf):
    return s.count_table(s.allele_freq(calls(spark, sf)))


@query(
    "af8_population_table",
    f'SELECT mutation AS "Identity", CAST(g AS DOUBLE) AS "Generation", share AS "Population" FROM ({SQL_NESTED})',
)
def af8_population(spark, sf):
    shares = nested(spark, sf)
    times = shares.select("g", F.col("g").cast("double").alias("x")).distinct()
    return s.population_table(shares, times).withColumn("Population", R("Population", 6))


@query("af8_edges", "SELECT 'm' || c_custkey // 2 AS \"Parent\", 'm' || c_custkey AS \"Identity\" FROM customer")
def af8_edges(spark, sf):
    key = F.col("c_custkey")
    parents = b.table(spark, sf, "customer").select(
        F.concat(F.lit("m"), key).alias("mutation"), F.concat(F.lit("m"), F.floor(key / 2)).alias("parent")
    )
    return s.edges_table(parents)
