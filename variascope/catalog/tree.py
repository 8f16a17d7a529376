"""Queries over sample distances, lineages and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from variascope import bindings as b
from variascope.bindings import N_NODE_SITES, N_SITES, SQL_CELLS, SQL_NODE_CALLS, SQL_TREE
from variascope.operators import calls as c
from variascope.operators import tree as t
from variascope.registry import query

R = F.round


def pair_calls(spark, sf):
    """Major alleles of cells with at least two reads."""
    return c.major_minor_allele(b.cells(spark, sf)).where("depth >= 2").select(
        "sample", F.col("p").alias("site"), F.col("major_nt").alias("call")
    )


def pair_samples(spark, sf):
    supplier = b.table(spark, sf, "supplier")
    return supplier.select(
        F.col("s_suppkey").alias("sample"),
        (F.col("s_nationkey") * 10).cast("long").alias("day"),
        (F.col("s_nationkey") % 2 == 0).alias("focal"),
        (F.col("s_nationkey") % 5).alias("species"),
    )


SQL_PAIRS = SQL_CELLS + """,
pc AS (SELECT sample, p, major_nt AS call FROM majors WHERE depth >= 2),
sm AS (SELECT s_suppkey AS sample, CAST(s_nationkey * 10 AS BIGINT) AS day, s_nationkey % 2 = 0 AS focal, s_nationkey % 5 AS species FROM supplier),
dd AS (SELECT a.sample AS s1, b.sample AS s2, count(*) FILTER (a.call <> b.call) AS k FROM pc a JOIN pc b ON a.p = b.p AND a.sample < b.sample GROUP BY 1, 2),
pd AS (SELECT x.sample AS s1, y.sample AS s2, coalesce(k, 0) AS snp_diff, abs(x.day - y.day) AS time_diff, x.focal AS f1, y.focal AS f2, x.species AS sp1, y.species AS sp2
  FROM sm x JOIN sm y ON x.sample < y.sample LEFT JOIN dd ON dd.s1 = x.sample AND dd.s2 = y.sample)"""


@query("tr1_pairwise_snp", f"WITH {SQL_PAIRS} SELECT s1, s2, snp_diff, time_diff FROM pd")
def tr1(spark, sf):
    return t.pairwise_snp(pair_calls(spark, sf), pair_samples(spark, sf), n_sites=N_SITES)


@query(
    "tr1_pairwise_snp_grouped",
    f"WITH {SQL_PAIRS} SELECT sp1 AS species, s1, s2, snp_diff, time_diff FROM pd WHERE sp1 = sp2",
)
def tr1_grouped(spark, sf):
    samples = pair_samples(spark, sf)
    calls = pair_calls(spark, sf).join(samples.select("sample", "species"), "sample")
    return t.pairwise_snp(calls, samples, n_sites=N_SITES, group=["species"], n_blocks=4)


@query(
    "tr2_nearest_other_class",
    f"""WITH {SQL_PAIRS}, o AS (SELECT s1 AS sample, s2 AS other, snp_diff, time_diff FROM pd WHERE f1 AND NOT f2 UNION ALL
      SELECT s2, s1, snp_diff, time_diff FROM pd WHERE f2 AND NOT f1),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY snp_diff, other) AS rk FROM o)
    SELECT sample, other AS nearest, snp_diff, time_diff FROM r WHERE rk = 1""",
)
def tr2(spark, sf):
    return t.nearest_other_class(pair_calls(spark, sf), pair_samples(spark, sf), n_sites=N_SITES)


@query(
    "tr2_nearest_within_species",
    f"""WITH {SQL_PAIRS}, o AS (SELECT s1 AS sample, sp1 AS species, s2 AS other, snp_diff, time_diff FROM pd WHERE f1 AND NOT f2 AND sp1 = sp2
      UNION ALL SELECT s2, sp1, s1, snp_diff, time_diff FROM pd WHERE f2 AND NOT f1 AND sp1 = sp2),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY snp_diff, other) AS rk FROM o)
    SELECT species, sample, other AS nearest, snp_diff, time_diff FROM r WHERE rk = 1""",
)
def tr2_grouped(spark, sf):
    samples = pair_samples(spark, sf)
    calls = pair_calls(spark, sf).join(samples.select("sample", "species"), "sample")
    return t.nearest_other_class(calls, samples, n_sites=N_SITES, group=["species"])


#: Largest number of differing sites between neighbours of one lineage.
CUTOFF = 19


@query(
    "tr3_lineage_clusters",
    f"""WITH RECURSIVE {SQL_PAIRS}, e AS (SELECT s1 AS a, s2 AS b FROM pd WHERE snp_diff <= {CUTOFF} UNION ALL SELECT s2, s1 FROM pd WHERE snp_diff <= {CUTOFF}),
    w AS (SELECT sample AS v, sample AS r FROM sm UNION SELECT e.b, w.r FROM w JOIN e ON e.a = w.v),
    l AS (SELECT v AS sample, min(r) AS lineage FROM w GROUP BY 1)
    SELECT sample, lineage, count(*) OVER (PARTITION BY lineage) AS size FROM l""",
)
def tr3(spark, sf):
    return t.lineage_clusters(
        pair_calls(spark, sf), pair_samples(spark, sf), n_sites=N_SITES, cutoff=CUTOFF
    )


@query(
    "tr4_distance_histogram",
    f"""WITH {SQL_PAIRS} SELECT time_diff, CASE WHEN snp_diff <= 25 THEN snp_diff ELSE (snp_diff - 26) // 5 * 5 + 26 END AS bin, count(*) AS n FROM pd GROUP BY 1, 2""",
)
def tr4(spark, sf):
    return t.pair_histogram(pair_calls(spark, sf), pair_samples(spark, sf), n_sites=N_SITES, fine_to=25, coarse=5)


SQL_CLOSURE = SQL_TREE + """,
up AS (SELECT child AS node, child AS ancestor, CAST(0 AS BIGINT) AS steps FROM tree UNION ALL
  SELECT up.node, tree.parent, up.steps + 1 FROM up JOIN tree ON tree.child = up.ancestor WHERE tree.parent IS NOT NULL),
dep AS (SELECT node, max(steps) AS depth FROM up GROUP BY 1),
tip AS (SELECT child AS node FROM tree WHERE child NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL))"""


@query("tr5_tree_closure", f"WITH RECURSIVE {SQL_CLOSURE} SELECT node, ancestor, steps FROM up")
def tr5(spark, sf):
    return t.tree_closure(t.Tree(b.heap_tree(spark, sf)))


def tip_sets(spark, sf, tree):
    """Sets of tips that share the fourth-level ancestor region and nation parity."""
    nodes = t.tips(tree).join(tree.select(F.col("child").alias("node"), "nation"), "node")
    return nodes.select((F.floor(F.col("node") / 16) * 10 + F.col("nation") % 2).alias("set_id"), "node")


SQL_SETS = "sets AS (SELECT tip.node // 16 * 10 + nation % 2 AS set_id, tip.node FROM tip JOIN tree ON child = tip.node)"
SQL_MRCA = """sz AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1),
cm AS (SELECT set_id, ancestor, count(*) AS k FROM sets JOIN up ON up.node = sets.node GROUP BY 1, 2),
mr AS (SELECT cm.set_id, ancestor AS mrca, depth, n, row_number() OVER (PARTITION BY cm.set_id ORDER BY depth DESC) AS rk FROM cm JOIN sz ON sz.set_id = cm.set_id AND k = n
  JOIN dep ON dep.node = ancestor)"""


@query(
    "tr5_mrca",
    f"WITH RECURSIVE {SQL_CLOSURE}, {SQL_SETS}, {SQL_MRCA} SELECT set_id, mrca, depth, n AS n_tips FROM mr WHERE rk = 1",
)
def tr5_mrca(spark, sf):
    tree = b.heap_tree(spark, sf)
    return t.mrca(tip_sets(spark, sf, tree), t.Tree(tree))


@query(
    "tr5_tips_below",
    f"WITH RECURSIVE {SQL_CLOSURE} SELECT ancestor, count(*) AS n_tips FROM up WHERE node IN (SELECT node FROM tip) GROUP BY 1",
)
def tr5_tips(spark, sf):
    tree = b.heap_tree(spark, sf)
    return t.tips_below(tree, t.Tree(tree))


@query(
    "tr5_breadth_first_order",
    f"WITH RECURSIVE {SQL_CLOSURE} SELECT node, depth, CAST(row_number() OVER (PARTITION BY depth ORDER BY node) AS INTEGER) AS place FROM dep",
)
def tr5_order(spark, sf):
    return t.breadth_first_order(t.Tree(b.heap_tree(spark, sf)))


SQL_CHANGES = SQL_NODE_CALLS + """,
ch AS (SELECT c.site, t.child AS node, t.parent, q.nt AS from_nt, c.nt AS to_nt FROM tree t JOIN node_calls c ON c.node = t.child
  JOIN node_calls q ON q.node = t.parent AND q.site = c.site WHERE c.nt <> q.nt AND c.nt <> 'N' AND q.nt <> 'N')"""


def changes(spark, sf, **kw):
    return t.edge_changes(b.heap_tree(spark, sf), b.node_calls(spark, sf), **kw)


@query(
    "tr6_events_per_site",
    f"""WITH {SQL_TREE}, {SQL_CHANGES} SELECT s.site, count(ch.site) AS events FROM (SELECT DISTINCT site FROM node_calls) s LEFT JOIN ch ON ch.site = s.site GROUP BY 1""",
)
def tr6(spark, sf):
    return t.events_per_site(changes(spark, sf), b.node_calls(spark, sf))


@query(
    "tr6_events_inner_only",
    f"""WITH {SQL_TREE}, {SQL_CHANGES} SELECT s.site, count(ch.site) AS events FROM (SELECT DISTINCT site FROM node_calls) s
    LEFT JOIN (SELECT * FROM ch WHERE node IN (SELECT parent FROM tree)) ch ON ch.site = s.site GROUP BY 1""",
)
def tr6_inner(spark, sf):
    return t.events_per_site(changes(spark, sf, skip_tips=True), b.node_calls(spark, sf))


@query(
    "tr7_homoplasy_distance",
    f"""WITH RECURSIVE {SQL_CLOSURE}, {SQL_CHANGES},
    pr AS (SELECT x.site, x.to_nt, x.node, y.node AS other FROM ch x JOIN ch y ON x.site = y.site AND x.to_nt = y.to_nt AND x.node <> y.node),
    pq AS (SELECT DISTINCT node, other FROM pr),
    ds AS (SELECT pq.node, pq.other, min(u.steps + v.steps) AS path FROM pq JOIN up u ON u.node = pq.node JOIN up v ON v.node = pq.other AND v.ancestor = u.ancestor GROUP BY 1, 2),
    rk AS (SELECT pr.*, path, row_number() OVER (PARTITION BY pr.site, pr.to_nt, pr.node ORDER BY path, pr.other) AS r FROM pr JOIN ds ON ds.node = pr.node AND ds.other = pr.other)
    SELECT site, to_nt, node, other AS nearest, path FROM rk WHERE r = 1""",
)
def tr7(spark, sf):
    closure = t.tree_closure(t.Tree(b.heap_tree(spark, sf)))
    return t.homoplasy_nearest(changes(spark, sf), closure).select("site", "to_nt", "node", "nearest", "path")


@query(
    "tr7_node_differences",
    f"""WITH {SQL_TREE}, {SQL_NODE_CALLS} SELECT child, parent, count(*) FILTER (a.nt <> b.nt) AS differences FROM tree JOIN node_calls a ON a.node = child
    JOIN node_calls b ON b.node = parent AND b.site = a.site GROUP BY 1, 2""",
)
def tr7_differences(spark, sf):
    edges = b.heap_tree(spark, sf).where("parent IS NOT NULL").select("child", "parent")
    return t.node_differences(edges, b.node_calls(spark, sf), n_sites=N_NODE_SITES, a="child", b="parent")


@query(
    "tr8_homoplasy_support",
    f"""WITH {SQL_TREE}, {SQL_CHANGES} SELECT site, count(*) AS events, count(*) FILTER (t.weight < 2000) AS weak, count(*) - count(*) FILTER (t.weight < 2000) AS supported
    FROM ch JOIN tree t ON t.child = ch.parent GROUP BY 1 HAVING count(*) > 1""",
)
def tr8(spark, sf):
    support = b.heap_tree(spark, sf).select(F.col("child").alias("node"), F.col("weight").alias("support"))
    return t.homoplasy_support(changes(spark, sf), support, min_support=2000)


FOLD_SQL = "CASE " + " ".join(f"WHEN from_nt || to_nt = '{k}' THEN '{v}'" for k, v in t.FOLDED.items()) + " END"
SHARES_SQL = ", ".join(
    f"round(count(*) FILTER (cls = '{x}') * 1.0 / greatest(count(cls), 1), 6) AS \"{x}\"" for x in t.CLASSES
)


@query(
    "tr9_spectrum_per_subtree",
    f"""WITH RECURSIVE {SQL_CLOSURE}, {SQL_CHANGES}, f AS (SELECT node, {FOLD_SQL} AS cls FROM ch)
    SELECT p.parent AS node, count(cls) AS total, {SHARES_SQL} FROM (SELECT DISTINCT parent FROM tree WHERE parent IS NOT NULL) p
    LEFT JOIN up ON up.ancestor = p.parent LEFT JOIN f ON f.node = up.node GROUP BY 1""",
)
def tr9(spark, sf):
    tree = b.heap_tree(spark, sf)
    out = t.spectrum_per_subtree(changes(spark, sf), t.Tree(tree), tree)
    return out.select("node", "total", *[R(x, 6).alias(x) for x in t.CLASSES])


def genotype_sets(spark, sf, edges, tree):
    """Genotype per inner node of even nation: the tips below it, outside one segment."""
    segments = edges.where("segment <> 'BUILDING'").select(F.col("child").alias("node"))
    inner = edges.where("parent IS NOT NULL").select(F.col("parent").alias("child")).distinct()
    owners = edges.where("nation % 2 = 0").join(inner, "child", "left_semi").select(F.col("child").alias("set_id"))
    spans = tree.nodes.select(F.col("node").alias("set_id"), F.col("enter").alias("_from"), F.col("exit").alias("_to")).join(owners.hint("merge"), "set_id")
    places = t.tips(edges).join(segments.hint("merge"), "node").join(tree.nodes.select("node", "enter").hint("merge"), "node")
    return t.interval_join(places, spans, point="enter", start="_from", end="_to", width=4096).select("set_id", "node")


SQL_GENOTYPES = """sets AS (SELECT up.ancestor AS set_id, up.node FROM up JOIN tip ON tip.node = up.node JOIN tree o ON o.child = up.ancestor AND o.nation % 2 = 0
  JOIN tree s ON s.child = up.node AND s.segment <> 'BUILDING' WHERE up.ancestor IN (SELECT parent FROM tree WHERE parent IS NOT NULL))"""
SQL_PARENTS = SQL_MRCA + """,
m1 AS (SELECT set_id, mrca, depth, n FROM mr WHERE rk = 1),
ab AS (SELECT m.set_id, q.set_id AS cand, row_number() OVER (PARTITION BY m.set_id ORDER BY q.depth DESC, q.set_id) AS r FROM m1 m JOIN up ON up.node = m.mrca AND up.steps > 0 JOIN m1 q ON q.mrca = up.ancestor),
bs AS (SELECT m.set_id, m.n, coalesce(CAST(cand AS VARCHAR), 'root') AS parent FROM m1 m LEFT JOIN ab ON ab.set_id = m.set_id AND r = 1),
ne AS (SELECT x.set_id AS s, y.set_id AS l, y.n AS nl FROM bs x JOIN bs y ON x.parent = y.parent AND x.n < y.n WHERE
  (SELECT count(*) FROM sets a JOIN sets b ON a.node = b.node WHERE a.set_id = x.set_id AND b.set_id = y.set_id) = x.n),
fi AS (SELECT s, l, row_number() OVER (PARTITION BY s ORDER BY nl, l) AS r FROM ne),
pa AS (SELECT bs.set_id, coalesce(CAST(l AS VARCHAR), parent) AS parent FROM bs LEFT JOIN fi ON s = bs.set_id AND r = 1)"""


@query(
    "tr10_closest_ancestor_genotype",
    f"WITH RECURSIVE {SQL_CLOSURE}, {SQL_GENOTYPES}, {SQL_PARENTS} SELECT set_id, parent FROM pa",
)
def tr10(spark, sf):
    edges = b.heap_tree(spark, sf)
    tree = t.Tree(edges)
    return t.closest_ancestor_genotype(genotype_sets(spark, sf, edges, tree), tree)


@query(
    "tr10_genotype_chain",
    f"""WITH RECURSIVE {SQL_CLOSURE}, {SQL_GENOTYPES}, {SQL_PARENTS}, pp AS MATERIALIZED (SELECT * FROM pa),
    gc AS (SELECT CAST(set_id AS VARCHAR) AS set_id, CAST(set_id AS VARCHAR) AS chain, parent FROM pp UNION ALL
      SELECT gc.set_id, gc.parent || '; ' || gc.chain, pp.parent FROM gc JOIN pp ON CAST(pp.set_id AS VARCHAR) = gc.parent)
    SELECT set_id, chain FROM gc WHERE parent = 'root'""",
)
def tr10_chain(spark, sf):
    return t.genotype_chain(t.cut(tr10(spark, sf)))


SQL_LINKED = """s AS (SELECT l_partkey AS mutation, list_sort(list(DISTINCT l_suppkey % 4)) AS samples FROM lineitem GROUP BY 1),
lm AS (SELECT mutation, samples, min(mutation) OVER (PARTITION BY samples) AS first, count(*) OVER (PARTITION BY samples) AS n FROM s)"""


def carriers(spark, sf):
    return b.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("mutation"), (F.col("l_suppkey") % 4).alias("sample"))


@query("tr11_linked_mutations", f"WITH {SQL_LINKED} SELECT mutation, first, n FROM lm")
def tr11(spark, sf):
    return t.linked_mutations(carriers(spark, sf))


@query("tr11_linked_carriers", f"WITH {SQL_LINKED} SELECT first, n, unnest(samples) AS sample FROM lm WHERE mutation = first")
def tr11_carriers(spark, sf):
    return t.linked_carriers(carriers(spark, sf), t.linked_mutations(carriers(spark, sf)))


@query(
    "tr12_substitution_spectrum",
    f"""WITH {SQL_NODE_CALLS}, al AS (SELECT DISTINCT node // 10 AS n, site, substr('ATCG', CAST(site % 4 + 1 AS BIGINT), 1) AS anc, nt FROM node_calls WHERE nt <> 'N' AND nt <> substr('ATCG', CAST(site % 4 + 1 AS BIGINT), 1)),
    sb AS (SELECT anc || nt AS sub FROM al UNION ALL SELECT nt || anc FROM al)
    SELECT sub, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM sb GROUP BY 1""",
)
def tr12(spark, sf):
    rows = b.node_calls(spark, sf).select(
        F.struct(F.floor(F.col("node") / 10).alias("n"), "site").alias("site"),
        F.substring(F.lit("ATCG"), (F.col("site") % 4 + 1).cast("int"), F.lit(1)).alias("anc"),
        "nt",
    )
    return t.substitution_spectrum(rows).withColumn("share", R("share", 6))


@query(
    "tr13_differences_to_root",
    f"""WITH {SQL_CELLS} SELECT sample, count(*) FILTER (depth >= 5 AND major_nt <> p % 4) AS differences FROM majors GROUP BY 1""",
)
def tr13(spark, sf):
    calls = c.major_minor_allele(b.cells(spark, sf)).select(
        "sample", F.col("p").alias("site"), F.when(F.col("depth") >= 5, F.col("major_nt")).alias("call")
    )
    ancestor = calls.select("site").distinct().withColumn("anc", (F.col("site") % 4).cast("int"))
    return t.differences_to_root(calls, ancestor)
