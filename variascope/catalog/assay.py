"""Queries over assay and clinical tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from variascope import bindings as b
from variascope.catalog import distributions as dist
from variascope.operators import assay as a
from variascope.operators import clinical as c
from variascope.registry import query

R = F.round


def r6(df, *cols):
    return df.select(*[R(x, 6).alias(x) if x in cols else F.col(x) for x in df.columns])


# ---- dilutions ----

SQL_WIDE = """w AS (SELECT o_orderkey AS well, o_orderpriority AS strain, CASE WHEN o_orderkey % 5 = 0 THEN 'many' ELSE CAST(o_custkey % 4 AS VARCHAR) END AS dil_1,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 6 AS VARCHAR) END AS dil_2, CAST(o_custkey % 9 AS VARCHAR) AS dil_3 FROM orders),
l AS (SELECT well, strain, 1 AS d, try_cast(dil_1 AS DOUBLE) AS v FROM w UNION ALL SELECT well, strain, 2, try_cast(dil_2 AS DOUBLE) FROM w UNION ALL SELECT well, strain, 3, try_cast(dil_3 AS DOUBLE) FROM w)"""


def dilutions(spark, sf):
    o = b.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("well"), F.col("o_orderpriority").alias("strain"),
        F.when(F.col("o_orderkey") % 5 == 0, "many").otherwise((F.col("o_custkey") % 4).cast("string")).alias("dil_1"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 6).cast("string")).alias("dil_2"),
        (F.col("o_custkey") % 9).cast("string").alias("dil_3"),
    )


@query(
    "ph1_countable_dilution",
    f"WITH {SQL_WIDE} SELECT well, strain, min(d) + 2 AS d, arg_min(v, d) * pow(10.0, min(d) + 2) AS value FROM l WHERE v > 0 GROUP BY 1, 2",
)
def ph1(spark, sf):
    return a.countable_dilution(dilutions(spark, sf), ids=["well", "strain"], dilutions=["dil_1", "dil_2", "dil_3"])


@query(
    "ph1_countable_dilution_highest",
    f"WITH {SQL_WIDE} SELECT well, strain, max(d) AS d, arg_max(v, d) * pow(10.0, max(d)) AS value FROM l WHERE v > 0 GROUP BY 1, 2",
)
def ph1_highest(spark, sf):
    return a.countable_dilution(
        dilutions(spark, sf), ids=["well", "strain"], dilutions=["dil_1", "dil_2", "dil_3"], offset=0, highest=True
    )


@query(
    "ph2_replicate_no",
    """SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY date_trunc('month', o_orderdate)) AS INTEGER) AS exp_replicate FROM orders""",
)
def ph2(spark, sf):
    rows = b.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("strain"), F.date_trunc("month", "o_orderdate").alias("date"))
    return a.replicate_no(rows).select("o_orderkey", "exp_replicate")


SQL_ADH = """x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m') AS date, l_suppkey % 5 AS strain, CASE WHEN l_linenumber = 1 THEN 'input' ELSE 'wash' END AS step,
  CASE WHEN l_returnflag = 'N' THEN 'bacteria_only' ELSE 'cells' END AS arm, l_extendedprice AS value FROM lineitem),
m AS (SELECT date, strain, avg(value) FILTER (step = 'input') AS i, avg(value) FILTER (arm = 'bacteria_only') AS g, avg(value) AS a FROM x GROUP BY 1, 2)"""


def adherence(spark, sf):
    return b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("date"), (F.col("l_suppkey") % 5).alias("strain"),
        F.when(F.col("l_linenumber") == 1, "input").otherwise("wash").alias("step"),
        F.when(F.col("l_returnflag") == "N", "bacteria_only").otherwise("cells").alias("arm"), F.col("l_extendedprice").alias("value"),
    )


@query(
    "ph3_relative_to_input",
    f"""WITH {SQL_ADH} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    round((value - g) / i * 100, 6) AS rel_background, round(value / i * 100, 6) AS rel FROM x JOIN m ON m.date = x.date AND m.strain = x.strain""",
)
def ph3(spark, sf):
    out = a.relative_to_input(adherence(spark, sf))
    return r6(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rel_background", "rel"), "rel_background", "rel")


@query(
    "ph3_ratio_to_mean",
    f"""WITH {SQL_ADH} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    round(value / a, 6) AS ratio FROM x JOIN m ON m.date = x.date AND m.strain = x.strain""",
)
def ph3_ratio(spark, sf):
    out = a.ratio_to_mean(adherence(spark, sf), by=["date", "strain"])
    return r6(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ratio"), "ratio")


# ---- growth ----

SQL_GROWTH = """rd AS (SELECT user_id AS well, user_id % 60 AS sample, CAST(floor((epoch_us(ts) - 1704067200000000) / 86400000000.0) AS BIGINT) * 1207 AS t, CAST(sum(CAST(round(value * 100) AS BIGINT)) * 100 // count(*) AS BIGINT) / 1e6 AS od, coalesce(stddev_samp(value), 0) / 100 AS sd,
  CASE WHEN user_id % 10 = 0 THEN 'negative' END AS control FROM events GROUP BY user_id, 3),
bad AS (SELECT well, arg_max(od, t) - arg_min(od, t) AS rise FROM rd WHERE control = 'negative' GROUP BY 1 HAVING arg_max(od, t) - arg_min(od, t) > 0.2),
bl AS (SELECT t, avg(od) AS blank FROM rd WHERE control = 'negative' AND sd <= 0.6 AND well NOT IN (SELECT well FROM bad) GROUP BY 1),
nm AS (SELECT rd.*, blank, od - blank AS norm_od FROM rd LEFT JOIN bl ON bl.t = rd.t WHERE control IS NULL),
rt AS (SELECT *, CASE WHEN count(norm_od) OVER w3 = 3 THEN avg(norm_od) OVER w3 END AS smoothed FROM nm WINDOW w3 AS (PARTITION BY well ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
ra AS (SELECT *, (smoothed - lag(smoothed) OVER w) / (t - lag(t) OVER w) AS rate FROM rt WINDOW w AS (PARTITION BY well ORDER BY t))"""


def readings(spark, sf):
    ev = b.table(spark, sf, "events")
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(86400000000))
    # readings are whole millionths: sums are exact, so means do not depend on the order of the rows
    micro = F.floor(F.sum(F.round(F.col("value") * 100).cast("long")) * 100 / F.count(F.lit(1)))
    return ev.groupBy(F.col("user_id").alias("well"), (day * 1207).alias("t")).agg(
        (micro / 1e6).alias("od"), (F.coalesce(F.stddev_samp("value"), F.lit(0.0)) / 100).alias("sd")
    ).withColumn("sample", F.col("well") % 60).withColumn("control", F.when(F.col("well") % 10 == 0, "negative"))


def normalised(spark, sf):
    rows = readings(spark, sf)
    return a.blank_subtract(rows, a.contaminated_wells(rows), max_sd=0.6)


@query("gr1_contaminated_wells", f"WITH {SQL_GROWTH} SELECT well, round(rise, 6) AS rise FROM bad")
def gr1(spark, sf):
    return r6(a.contaminated_wells(readings(spark, sf)), "rise")


@query("gr2_blank_subtract", f"WITH {SQL_GROWTH} SELECT well, t, round(norm_od, 9) AS norm_od FROM nm")
def gr2(spark, sf):
    return normalised(spark, sf).select("well", "t", R("norm_od", 9).alias("norm_od"))


@query(
    "gr3_drop_no_growth",
    f"""WITH {SQL_GROWTH}, wl AS (SELECT sample, well, max(norm_od) - min(norm_od) AS r FROM nm GROUP BY 1, 2), ok AS (SELECT sample FROM wl GROUP BY 1 HAVING bool_and(r >= 1.5))
    SELECT well, t FROM nm WHERE sample IN (SELECT sample FROM ok)""",
)
def gr3(spark, sf):
    return a.drop_no_growth(normalised(spark, sf), min_rise=1.5).select("well", "t")


@query("gr4_sliding_rate", f"WITH {SQL_GROWTH} SELECT well, t, round(smoothed, 8) AS smoothed, round(rate * 1e6, 4) AS rate FROM ra")
def gr4(spark, sf):
    return a.sliding_rate(normalised(spark, sf)).select("well", "t", R("smoothed", 8).alias("smoothed"), R(F.col("rate") * 1e6, 4).alias("rate"))


@query(
    "gr5_max_rate",
    f"""WITH {SQL_GROWTH}, k AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY rate DESC, t) AS r FROM ra WHERE rate IS NOT NULL) SELECT well, t AS t_max, round(rate * 3600, 6) AS rate_per_hour FROM k WHERE r = 1""",
)
def gr5(spark, sf):
    return r6(a.max_rate(a.sliding_rate(normalised(spark, sf))), "rate_per_hour")


@query(
    "gr5_align_to_max",
    f"""WITH {SQL_GROWTH}, k AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY rate DESC, t) AS r FROM ra WHERE rate IS NOT NULL), mx AS (SELECT well, t AS tm FROM k WHERE r = 1),
    al AS (SELECT ra.well, sample, t, trunc((t - tm) / 10.0) * 10 AS rel_time FROM ra JOIN mx ON mx.well = ra.well WHERE rate IS NOT NULL)
    SELECT well, t, CAST(rel_time AS DOUBLE) AS rel_time FROM al WHERE (sample, rel_time) IN (SELECT (sample, rel_time) FROM al GROUP BY sample, rel_time HAVING count(*) >= 2)""",
)
def gr5_align(spark, sf):
    return a.align_to_max(a.sliding_rate(normalised(spark, sf))).select("well", "t", "rel_time")


# ---- qPCR ----

SQL_QPCR = """q AS (SELECT l_suppkey % 20 AS sample, l_linenumber % 3 AS rep, 'g' || l_partkey % 3 AS gene, l_returnflag AS phase, CASE WHEN l_linestatus = 'O' THEN 'sample' ELSE 'control' END AS kind,
  coalesce(CASE WHEN count(*) % 9 <> 0 THEN avg(l_quantity) / 10 + CASE WHEN l_linestatus = 'O' THEN 18 ELSE 20 END END, 40) AS ct FROM lineitem GROUP BY l_suppkey % 20, l_linenumber % 3, l_partkey % 3, l_returnflag, l_linestatus),
bo AS (SELECT s.sample, s.rep, s.gene, s.phase, s.ct AS cs, c.ct AS cc FROM (SELECT * FROM q WHERE kind = 'sample') s LEFT JOIN (SELECT * FROM q WHERE kind = 'control') c
  ON c.sample = s.sample AND c.rep = s.rep AND c.gene = s.gene AND c.phase = s.phase),
cl AS (SELECT *, CASE WHEN pow(2.0, -cs) - pow(2.0, -cc) > 0 THEN -log2(pow(2.0, -cs) - pow(2.0, -cc)) END AS cr FROM bo WHERE (sample, rep, phase) IN (SELECT (sample, rep, phase) FROM bo WHERE gene = 'g0' AND cc - cs >= 1.5)),
ef AS (SELECT 'g0' AS gene, 1.07::DOUBLE AS e UNION ALL SELECT 'g1', 1.03 UNION ALL SELECT 'g2', 1.04),
mc AS (SELECT sample, rep, gene, phase, avg(cr) AS mct FROM cl GROUP BY 1, 2, 3, 4),
rf AS (SELECT gene, phase, avg(mct) AS cref FROM mc WHERE sample < 4 GROUP BY 1, 2),
de AS (SELECT cl.*, e, cref - cr AS d FROM cl LEFT JOIN rf ON rf.gene = cl.gene AND rf.phase = cl.phase JOIN ef ON ef.gene = cl.gene)"""


def wells(spark, sf):
    li = b.table(spark, sf, "lineitem")
    kind = F.when(F.col("l_linestatus") == "O", "sample").otherwise("control")
    shift = F.when(F.col("kind") == "sample", 18).otherwise(20)
    return li.groupBy(
        (F.col("l_suppkey") % 20).alias("sample"), (F.col("l_linenumber") % 3).alias("rep"), F.concat(F.lit("g"), F.col("l_partkey") % 3).alias("gene"),
        F.col("l_returnflag").alias("phase"), kind.alias("kind"),
    ).agg(F.avg("l_quantity").alias("q"), F.count(F.lit(1)).alias("n")).select(
        "sample", "rep", "gene", "phase", "kind", F.when(F.col("n") % 9 != 0, F.col("q") / 10 + shift).alias("ct")
    )


def cleaned(spark, sf):
    return a.ct_clean(wells(spark, sf), reference_gene="g0", min_gap=1.5)


@query("qp1_ct_clean", f"WITH {SQL_QPCR} SELECT sample, rep, gene, phase, round(cc - cs, 6) AS ct_gap, round(cr, 6) AS ct_corrected FROM cl")
def qp1(spark, sf):
    return r6(cleaned(spark, sf).select("sample", "rep", "gene", "phase", "ct_gap", "ct_corrected"), "ct_gap", "ct_corrected")


@query(
    "qp2_fold_change",
    f"""WITH {SQL_QPCR}, fc AS (SELECT x.sample, x.rep, x.gene, x.phase, avg(pow(2 * x.e, x.d) / pow(2 * h.e, h.d)) AS f FROM de x LEFT JOIN de h ON h.gene = 'g0' AND h.sample = x.sample AND h.rep = x.rep AND h.phase = x.phase GROUP BY 1, 2, 3, 4)
    SELECT sample, rep, gene, phase, round(f, 6) AS fold_change, round(log2(f), 6) AS log2_fc FROM fc""",
)
def qp2(spark, sf):
    eff = spark.createDataFrame([("g0", 1.07), ("g1", 1.03), ("g2", 1.04)], "gene string, efficiency double")
    return r6(a.fold_change(cleaned(spark, sf), eff, reference_gene="g0", wildtype=F.col("sample") < 4), "fold_change", "log2_fc")


# ---- resistance ----

SQL_MIC = """mi AS (SELECT p_brand AS drug, p_name AS genotype, CASE WHEN p_size % 13 = 0 THEN '-' WHEN p_size % 11 = 0 THEN '>' || CAST(pow(2, p_size % 9) AS INTEGER) ELSE CAST(CAST(pow(2, p_size % 9) AS INTEGER) AS VARCHAR) END AS mic FROM part),
lv AS (SELECT drug, genotype, log2(try_cast(replace(mic, '>', '') AS DOUBLE)) AS l FROM mi)"""


def mics(spark, sf):
    level = F.pow(F.lit(2.0), F.col("p_size") % 9).cast("int").cast("string")
    return b.table(spark, sf, "part").select(
        F.col("p_brand").alias("drug"), F.col("p_name").alias("genotype"),
        F.when(F.col("p_size") % 13 == 0, "-").when(F.col("p_size") % 11 == 0, F.concat(F.lit(">"), level)).otherwise(level).alias("mic"),
    )


@query(
    "mic1_fold",
    f"""WITH {SQL_MIC} SELECT drug, max(l) FILTER (NOT contains(genotype, 'ring') AND NOT contains(genotype, 'red')) AS without, max(l) FILTER (contains(genotype, 'ring')) AS "with",
    pow(2.0, max(l) FILTER (contains(genotype, 'ring')) - max(l) FILTER (NOT contains(genotype, 'ring') AND NOT contains(genotype, 'red'))) AS fold FROM lv WHERE l IS NOT NULL GROUP BY 1""",
)
def mic1(spark, sf):
    return a.mic_fold(mics(spark, sf), mutation="ring", exclude=["red"])


@query("mic1_mean", f"WITH {SQL_MIC} SELECT drug, genotype, round(avg(l), 6) AS mean_log2, count(l) AS n FROM lv GROUP BY 1, 2")
def mic1_mean(spark, sf):
    return r6(a.mic_mean(mics(spark, sf)), "mean_log2")


# ---- survival ----

SQL_SURVIVAL = """ev AS (SELECT user_id AS vial, user_id % 3 AS genotype, user_id % 4 AS experiment, CAST(floor((epoch_us(ts) - 1704067200000000) / 432000000000.0) AS BIGINT) AS time, event_type = 'error' AS died FROM events),
pd AS (SELECT vial, genotype, experiment, time, count(*) FILTER (died) AS k FROM ev GROUP BY 1, 2, 3, 4),
al AS (SELECT vial, count(*) AS alive_start FROM ev GROUP BY 1),
sc AS (SELECT pd.vial, genotype, experiment, time, CAST(sum(k) OVER (PARTITION BY pd.vial ORDER BY time) AS BIGINT) AS dead, alive_start FROM pd JOIN al ON al.vial = pd.vial),
st AS (SELECT *, coalesce(dead - lag(dead) OVER (PARTITION BY vial ORDER BY time), 0) AS deaths FROM sc),
lt AS (SELECT genotype, experiment, max(time) AS t FROM sc GROUP BY 1, 2),
dt AS (SELECT genotype, experiment, time, TRUE AS event, sum(deaths) AS n FROM st GROUP BY 1, 2, 3 UNION ALL
  SELECT sc.genotype, sc.experiment, time, FALSE, sum(alive_start - dead) FROM sc JOIN lt ON lt.genotype = sc.genotype AND lt.experiment = sc.experiment AND sc.time = lt.t GROUP BY 1, 2, 3)"""


def vials(spark, sf):
    ev = b.table(spark, sf, "events")
    period = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(432000000000))
    per = ev.groupBy(F.col("user_id").alias("vial"), period.alias("time")).agg(
        F.count_if(F.col("event_type") == "error").alias("k"), F.count(F.lit(1)).alias("all")
    )
    alive = per.groupBy("vial").agg(F.sum("all").alias("alive_start"))
    dead = F.sum("k").over(Window.partitionBy("vial").orderBy("time"))
    return per.withColumn("dead", dead).join(alive, "vial").select(
        "vial", (F.col("vial") % 3).alias("genotype"), (F.col("vial") % 4).alias("experiment"), "time", "dead", "alive_start"
    )


def deaths(spark, sf):
    return a.death_table(vials(spark, sf), keys=["vial", "genotype", "experiment"], group=["genotype", "experiment"])


@query(
    "sv1_death_table",
    f"WITH {SQL_SURVIVAL} SELECT genotype, experiment, time, event, CAST(unnest(range(1, CAST(n AS BIGINT) + 1)) AS INTEGER) AS individual FROM dt WHERE n > 0",
)
def sv1(spark, sf):
    return deaths(spark, sf)


@query(
    "sv2_kaplan_meier",
    f"""WITH {SQL_SURVIVAL}, p AS (SELECT genotype, time, CAST(coalesce(sum(n) FILTER (event), 0) AS BIGINT) AS d, CAST(sum(n) AS BIGINT) AS lv FROM dt WHERE n > 0 GROUP BY 1, 2),
    k AS (SELECT *, CAST(sum(lv) OVER (PARTITION BY genotype ORDER BY time DESC) AS BIGINT) AS at_risk FROM p)
    SELECT genotype, time, d, at_risk, round(exp(sum(ln(CASE WHEN d = at_risk THEN 1 ELSE 1 - d * 1.0 / at_risk END)) OVER (PARTITION BY genotype ORDER BY time)) * CASE WHEN max(CAST(d = at_risk AS INT)) OVER (PARTITION BY genotype ORDER BY time) = 1 THEN 0 ELSE 1 END, 6) AS survival FROM k""",
)
def sv2(spark, sf):
    return r6(a.kaplan_meier(deaths(spark, sf), group=["genotype"]), "survival")


@query("sv3_cox_curve")
def sv3(spark, sf):
    rows = deaths(spark, sf)
    fit = a.cox_fit(rows, covariates=("genotype", "experiment"))
    return a.cox_curve(rows, fit, covariates=("genotype", "experiment"), at=[(g, fit["means"][1]) for g in (0.0, 1.0, 2.0)])


@query(
    "sv4_survival_share",
    f"""WITH {SQL_SURVIVAL} SELECT genotype, round(1 - median(dead * 1.0 / alive_start), 6) AS survived FROM sc WHERE time = (SELECT max(time) FROM sc) GROUP BY 1""",
)
def sv4(spark, sf):
    return r6(a.survival_share(vials(spark, sf), group=["genotype"]), "survived")


SQL_MW = """v AS (SELECT c_nationkey % 5 AS stratum, c_mktsegment AS arm, round(c_acctbal / 100) AS x FROM customer),
n AS (SELECT stratum, arm, count(*) AS k FROM v GROUP BY 1, 2),
u AS (SELECT a.stratum, a.arm AS g1, b.arm AS g2, sum(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0 END)::DOUBLE AS u FROM v a JOIN v b ON a.stratum = b.stratum AND a.arm < b.arm GROUP BY 1, 2, 3),
t AS (SELECT q.stratum, g1, g2, sum(k * k * k - k)::DOUBLE AS ties FROM (SELECT u.stratum, g1, g2, x, count(*) AS k FROM u JOIN v ON v.stratum = u.stratum AND v.arm IN (g1, g2) GROUP BY 1, 2, 3, 4) q GROUP BY 1, 2, 3)"""


def arms(spark, sf):
    return b.table(spark, sf, "customer").select(
        (F.col("c_nationkey") % 5).alias("stratum"), F.col("c_mktsegment").alias("arm"), R(F.col("c_acctbal") / 100).alias("x")
    )


@query(
    "st1_mann_whitney",
    f"""WITH {SQL_MW} SELECT u.stratum, u.g1, u.g2, a.k AS n1, b.k AS n2, u, round(greatest(abs(u - a.k * b.k / 2.0) - 0.5, 0) / sqrt(a.k * b.k / 12.0 * ((a.k + b.k + 1) - ties / ((a.k + b.k) * (a.k + b.k - 1.0)))), 6) AS z
    FROM u JOIN n a ON a.stratum = u.stratum AND a.arm = g1 JOIN n b ON b.stratum = u.stratum AND b.arm = g2 JOIN t ON t.stratum = u.stratum AND t.g1 = u.g1 AND t.g2 = u.g2""",
)
def st1(spark, sf):
    out = a.mann_whitney(arms(spark, sf), strata=["stratum"], group="arm", value="x")
    return out.select("stratum", "g1", "g2", "n1", "n2", "u", R("z", 6).alias("z"))


@query(
    "st1_mann_whitney_p",
    f"""WITH {SQL_MW}, zs AS (SELECT u.stratum, u.g1, u.g2, greatest(abs(u - a.k * b.k / 2.0) - 0.5, 0) / sqrt(a.k * b.k / 12.0 * ((a.k + b.k + 1) - ties / ((a.k + b.k) * (a.k + b.k - 1.0)))) AS z
      FROM u JOIN n a ON a.stratum = u.stratum AND a.arm = g1 JOIN n b ON b.stratum = u.stratum AND b.arm = g2 JOIN t ON t.stratum = u.stratum AND t.g1 = u.g1 AND t.g2 = u.g2),
    ps AS (SELECT *, {dist.normal_two_sided("z")} AS p FROM zs)
    SELECT stratum, g1, g2, round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM ps""",
)
def st1_p(spark, sf):
    out = a.mann_whitney(arms(spark, sf), strata=["stratum"], group="arm", value="x")
    return out.select("stratum", "g1", "g2", R("p", 6).alias("p"), "stars")


# ---- clinical ----

SQL_STAY = """bd AS (SELECT o_custkey AS patient, coalesce(min(o_orderdate) FILTER (o_orderpriority = '1-URGENT'), min(o_orderdate) FILTER (o_orderpriority = '2-HIGH'), min(o_orderdate)) AS first_day FROM orders GROUP BY 1),
en AS (SELECT c_custkey AS patient, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2002-01-01 10:00:00' + to_days(CAST(c_custkey % 100 AS INTEGER)) END AS death, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2001-12-01 08:00:00' END AS early_end FROM customer),
sb AS (SELECT bd.patient, first_day, date_trunc('day', coalesce(death, early_end, TIMESTAMP '2002-06-30')) + INTERVAL 1 DAY - INTERVAL 1 SECOND AS last_moment FROM bd LEFT JOIN en ON en.patient = bd.patient)"""


def stays(spark, sf):
    o = b.table(spark, sf, "orders")
    events = o.select(F.col("o_custkey").alias("patient"), F.col("o_orderpriority").alias("entry_type"), F.col("o_orderdate").alias("date"))
    events = events.unionByName(events.withColumn("entry_type", F.lit("any")))
    key = F.col("c_custkey")
    death = F.expr("timestampadd(DAY, c_custkey % 100, TIMESTAMP '2002-01-01 10:00:00')")
    endpoint = b.table(spark, sf, "customer").select(
        key.alias("patient"), F.when(key % 3 == 0, death).alias("death"),
        F.when(key % 5 == 0, F.lit("2001-12-01 08:00:00").cast("timestamp")).alias("early_end"),
    )
    return c.stay_bounds(events, endpoint, first=["1-URGENT", "2-HIGH", "any"], study_end="2002-06-30")


@query(
    "ct1_stay_bounds",
    f"WITH {SQL_STAY} SELECT patient, strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_moment, '%Y-%m-%d %H:%M:%S') AS last_moment, round(epoch(last_moment - first_day) / 86400.0, 6) AS days FROM sb",
)
def ct1(spark, sf):
    return stays(spark, sf).select(
        "patient", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("last_moment", "yyyy-MM-dd HH:mm:ss").alias("last_moment"), R("days", 6).alias("days")
    )


@query(
    "ct2_intervals_to_days",
    f"""WITH {SQL_STAY}, iv AS (SELECT o_custkey AS patient, 'drug' AS kind, o_orderdate AS begin, o_orderdate + to_days(CAST(o_orderkey % 9 AS INTEGER)) AS stop, o_orderpriority AS detail FROM orders UNION ALL
      SELECT o_custkey, 'sample', o_orderdate, NULL, NULL FROM orders WHERE o_orderstatus = 'F')
    SELECT DISTINCT iv.patient, kind, detail, round(epoch(begin - first_day) / 86400.0, 6) AS day_start, round(epoch(coalesce(stop, begin) - first_day) / 86400.0, 6) AS day_stop FROM iv JOIN sb ON sb.patient = iv.patient""",
)
def ct2(spark, sf):
    o = b.table(spark, sf, "orders")
    drug = o.select(
        F.col("o_custkey").alias("patient"), F.lit("drug").alias("kind"), F.col("o_orderdate").alias("begin"),
        F.expr("timestampadd(DAY, o_orderkey % 9, o_orderdate)").alias("stop"), F.col("o_orderpriority").alias("detail"),
    )
    sample = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("patient"), F.lit("sample").alias("kind"), F.col("o_orderdate").alias("begin"))
    out = c.intervals_to_days([drug, sample], stays(spark, sf))
    return r6(out.select("patient", "kind", "detail", "day_start", "day_stop"), "day_start", "day_stop").distinct()


SQL_DRUGS = """en AS (SELECT o_orderkey AS row_id, o_custkey AS patient, 1 AS entry, CASE WHEN o_orderkey % 4 <> 0 THEN 'd' || o_orderkey % 6 END AS drug, o_custkey % 5 || 'mg' AS dose, CAST(o_orderkey % 30 AS VARCHAR) AS "end" FROM orders
  UNION ALL SELECT o_orderkey, o_custkey, 2, CASE WHEN o_orderkey % 3 = 0 THEN 'd' || o_custkey % 6 END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 || 'g' END, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 30 AS VARCHAR) END FROM orders),
ex AS (SELECT row_id, patient, CAST(entry AS INTEGER) AS entry, drug, dose, "end", CASE WHEN drug IN ('d0', 'd1') THEN 'beta' WHEN drug IN ('d2', 'd3') THEN 'quin' END AS drug_class FROM en WHERE drug IS NOT NULL OR dose IS NOT NULL OR "end" IS NOT NULL)"""


def treatments(spark, sf):
    o = b.table(spark, sf, "orders")
    k, cu = F.col("o_orderkey"), F.col("o_custkey")
    second = k % 3 == 0
    wide = o.select(
        k.alias("row_id"), cu.alias("patient"), F.when(k % 4 != 0, F.concat(F.lit("d"), k % 6)).alias("drug_1"), F.concat(cu % 5, F.lit("mg")).alias("dose_1"),
        (k % 30).cast("string").alias("end_1"), F.when(second, F.concat(F.lit("d"), cu % 6)).alias("drug_2"), F.when(second, F.concat(k % 5, F.lit("g"))).alias("dose_2"),
        F.when(second, (cu % 30).cast("string")).alias("end_2"),
    )
    return c.treatment_reshape(
        wide, ids=["row_id", "patient"], columns=[f"{f}_{i}" for i in (1, 2) for f in ("drug", "dose", "end")],
        classes={"d0": "beta", "d1": "beta", "d2": "quin", "d3": "quin"}, fields=["drug", "dose", "end"],
    )


@query("ct3_treatment_reshape", f"WITH {SQL_DRUGS} SELECT * FROM ex")
def ct3(spark, sf):
    return treatments(spark, sf)


@query(
    "ct3_treatment_summary",
    f"""WITH {SQL_DRUGS} SELECT patient, drug, drug_class, string_agg(dose, ', ' ORDER BY entry, dose) AS doses, max("end") AS last_end, count(*) AS n_entries FROM ex GROUP BY 1, 2, 3""",
)
def ct3_summary(spark, sf):
    return c.treatment_summary(treatments(spark, sf))


KINDS = ["view", "signup", "error", "purchase", "click"]


@query(
    "ct4_isolate_counts",
    "SELECT user_id AS patient, CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS species, CAST(ts AS DATE) - DATE '2024-01-01' AS day, "
    + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + ", count(*) AS total FROM events GROUP BY 1, 2, 3",
)
def ct4(spark, sf):
    rows = b.table(spark, sf, "events").select(
        F.col("user_id").alias("patient"), (F.get_json_object("props", "$.k").cast("int") % 10).alias("species"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"), F.col("event_type").alias("source"),
    )
    return c.isolate_counts(rows, sources=KINDS)


SQL_AVAILABLE = """cl AS (SELECT o_orderkey AS sample_id, o_custkey AS patient, month(o_orderdate) * 10 AS day, o_orderpriority AS material FROM orders WHERE o_orderkey % 10 <> 3),
lb AS (SELECT o_orderkey AS sample_id, o_totalprice > 250000 AS available FROM orders WHERE o_orderstatus <> 'P'),
jn AS (SELECT coalesce(cl.sample_id, lb.sample_id) AS sample_id, patient, day, material, coalesce(available, FALSE) AS available FROM cl FULL JOIN lb ON lb.sample_id = cl.sample_id
  WHERE regexp_matches(material, '^[123]') AND day <= 90),
pk AS (SELECT *, row_number() OVER (PARTITION BY patient, day ORDER BY NOT available, sample_id) AS r, count(*) OVER (PARTITION BY patient, day) AS n FROM jn)"""


def availability(spark, sf):
    o = b.table(spark, sf, "orders")
    clinic = o.where("o_orderkey % 10 <> 3").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("patient"), (F.month("o_orderdate") * 10).cast("long").alias("day"), F.col("o_orderpriority").alias("material")
    )
    lab = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_totalprice") > 250000).alias("available"))
    return c.sample_availability(lab, clinic, material="^[123]")


@query("ct5_sample_availability", f"WITH {SQL_AVAILABLE} SELECT patient, day, sample_id, material, available, n FROM pk WHERE r = 1")
def ct5(spark, sf):
    return availability(spark, sf)


@query(
    "ct5_availability_share",
    f"WITH {SQL_AVAILABLE} SELECT patient, round(avg(CASE WHEN available THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n FROM pk WHERE r = 1 GROUP BY 1",
)
def ct5_share(spark, sf):
    return r6(c.availability_share(availability(spark, sf)), "share")


SQL_STATUS = """ds AS (SELECT l_suppkey AS patient, p_type AS species, l_returnflag AS site, bool_or(l_quantity > 48) AS m, bool_or(l_discount > 0.09) AS i FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
ss AS (SELECT *, CASE WHEN m AND i THEN 'both' WHEN m THEN 'microbiome' WHEN i THEN 'infection' END AS status FROM ds)"""


def status(spark, sf):
    li = b.table(spark, sf, "lineitem").join(b.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return c.detection_status(li.select(
        F.col("l_suppkey").alias("patient"), F.col("p_type").alias("species"), F.col("l_returnflag").alias("site"),
        (F.col("l_quantity") > 48).alias("in_microbiome"), (F.col("l_discount") > 0.09).alias("in_infection"),
    ))


@query("ct6_detection_status", f"WITH {SQL_STATUS} SELECT patient, species, site, m, i, status FROM ss")
def ct6(spark, sf):
    return status(spark, sf)


@query(
    "ct6_status_frequency",
    f"""WITH {SQL_STATUS} SELECT species, site, round(count(*) FILTER (status = 'both') * 1.0 / count(*), 6) AS "both", round(count(*) FILTER (status = 'microbiome') * 1.0 / count(*), 6) AS microbiome,
    round(count(*) FILTER (status = 'infection') * 1.0 / count(*), 6) AS infection, count(*) AS n FROM ss WHERE status IS NOT NULL GROUP BY 1, 2""",
)
def ct6_frequency(spark, sf):
    return r6(c.status_frequency(status(spark, sf)), "both", "microbiome", "infection")


@query(
    "ct7_tip_metadata",
    """SELECT c_custkey, 'I' || c_custkey AS isolate, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_nationkey AS INTEGER) END AS day, CASE WHEN c_custkey % 6 = 0 THEN 'reference' ELSE c_mktsegment END AS site, n AS n_orders
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def ct7(spark, sf):
    cu = b.table(spark, sf, "customer")
    label = F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("I"), "c_custkey")).otherwise(
        F.concat(F.lit("I"), "c_custkey", F.lit("_"), "c_nationkey", F.lit("_"), "c_mktsegment")
    )
    counts = b.table(spark, sf, "orders").groupBy(F.concat(F.lit("I"), "o_custkey").alias("isolate")).agg(F.count(F.lit(1)).alias("n_orders"))
    return c.tip_metadata(cu.select("c_custkey", label.alias("label")), [counts], label=F.col("label")).select("c_custkey", "isolate", "day", "site", "n_orders")
