"""Plans and results that must hold when tables grow: what is broadcast, what is paired, what is collected."""

import random
import statistics

from pyspark.sql import functions as F

from variascope.operators import segments, tree
from variascope.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def small_tree(spark, n=200):
    node = F.col("id") + 1
    return spark.range(n).select(node.alias("child"), F.when(node > 1, F.floor(node / 2).cast("long")).alias("parent"))


def test_exploded_calls_are_not_broadcast(spark):
    edges = small_tree(spark)
    sites = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long")))
    calls = edges.select(F.col("child").alias("node"), sites.alias("site")).withColumn(
        "nt", F.substring(F.lit("ATCGN"), ((F.col("node") * 7 + F.col("site")) % 5 + 1).cast("int"), F.lit(1))
    )
    changes = tree.edge_changes(edges, calls)
    assert "Broadcast" not in plan(changes)
    letter = lambda x, s: "ATCGN"[(x * 7 + s) % 5]
    expected = sum(letter(x, s) != letter(x // 2, s) and "N" not in (letter(x, s), letter(x // 2, s)) for x in range(2, 201) for s in range(24))
    assert changes.count() == expected


def test_tree_tables_are_not_broadcast(spark):
    edges = small_tree(spark)
    nodes = tree.Tree(edges)
    ones = edges.select(F.col("child").alias("node"), F.lit(1).cast("long").alias("n"))
    sums = nodes.subtree_sums(ones, ["n"])
    # the totals of tiles, one row in 65 536 places, may be broadcast, node tables may not
    assert plan(nodes.meeting(spark.createDataFrame([(4, 5)], "a long, b long"), first="a", last="b")).count("Broadcast") == 0
    assert sums.where("node = 1").first().n == 200


def test_medians_only_where_half_is_covered(spark):
    """Every window of every sample against a plain median."""
    rnd = random.Random(3)
    depth = {(s, p): rnd.choice([1, 2, 3, 5]) for s in range(6) for p in range(60) if rnd.random() < (0.15, 0.35, 0.5, 0.6, 0.9, 0.3)[s]}
    cov = spark.createDataFrame([(s, p, c) for (s, p), c in depth.items()], "sample long, p long, cov long")
    spans = [(a, b) for a in range(60) for b in range(a + 1, 61, 3)]
    regions = spark.createDataFrame(spans, "start long, end long")
    for above in (0, 2):
        expected = {}
        for s in range(6):
            for a, b in spans:
                m = statistics.median(depth.get((s, p), 0) for p in range(a, b))
                if m > above:
                    expected[s, a, b] = m
        got = segments.region_medians(cov, regions, above=above, width=16)
        assert {(r["sample"], r["start"], r["end"]): r["median"] for r in got.collect()} == expected
    # a sparse sample has short stretches only, so most regions do not meet it
    assert sum(min(r["end"], 60) - max(r["start"], 0) for r in segments.half_covered(cov, 0).where("sample = 0").collect()) < 40


def test_matrix_of_more_samples_than_csv_has_columns(spark, tmp_path):
    """Spark reads at most 20 480 CSV columns; the matrix has one line a site and any number of samples."""
    n = 21_000
    calls = spark.range(n).select((F.col("id") % 2).alias("p"), F.concat(F.lit("s"), "id").alias("sample"), (F.col("id") % 4).cast("int").alias("call"))
    sinks.write_call_matrix(calls, str(tmp_path / "m"), samples=[f"s{i}" for i in range(n)])
    back = sinks.read_call_matrix(spark, str(tmp_path / "m"))
    assert back.count() == 2 * n and back.where("nt = '?'").count() == n
    assert back.join(calls, ["p", "sample"]).where("nt <> substr('ATCG', call + 1, 1)").count() == 0
    wide = spark.read.csv(str(tmp_path / "m"), header=True, maxColumns=30_000)
    assert wide.columns == ["p", *sorted(f"s{i}" for i in range(n))]


def test_pseudogenome_edits_chunks(spark):
    rnd = random.Random(5)
    seqs = {i: "".join(rnd.choice("ATCG") for _ in range(rnd.choice([1, 7, 8, 40, 61]))) for i in range(6)}
    snvs = {(s, i, p): rnd.choice("ATCGN") for s in range(5) for i, q in seqs.items() for p in range(len(q)) if s and rnd.random() < s * s * 0.01}
    got = sinks.pseudogenome(
        spark.createDataFrame(list(seqs.items()), "contig_idx int, seq string"),
        spark.createDataFrame([(*k, v) for k, v in snvs.items()], "sample long, contig_idx int, pos long, nt string"),
        spark.range(5).withColumnRenamed("id", "sample"), padding=2, chunk=8,
    )
    assert {r["sample"]: r["seq"] for r in got.collect()} == {
        s: "NN".join("".join(snvs.get((s, i, p), x) for p, x in enumerate(seqs[i])) for i in sorted(seqs)) for s in range(5)
    }
    # chunks without changes are no rows
    assert "posexplode" not in plan(got)


def test_pseudogenome_shuffles_edits_only(spark):
    """Texts were dealt by sample; only edits are, and the reference once a block. Edits outside a contig are none."""
    contigs = spark.createDataFrame([(1, "ACGTACGTAC"), (4, "é" * 5), (2, None), (3, "TTT")], "contig_idx int, seq string")
    rows = [(0, 1, 9, "N"), (0, 3, 0, "G"), (0, 3, 3, "C"), (0, 3, -1, "C"), (0, 7, 0, "C"), (1, 4, 4, "A"), (9, 1, 1, "N")]
    snvs = spark.createDataFrame(rows, "sample long, contig_idx int, pos long, nt string")
    got = sinks.pseudogenome(contigs, snvs, spark.range(3).withColumnRenamed("id", "sample"), padding=1, chunk=4)
    assert {r["sample"]: r["seq"] for r in got.collect()} == {0: "ACGTACGTANNGTTNééééé", 1: "ACGTACGTACNTTTNééééA", 2: "ACGTACGTACNTTTNééééé"}
    dealt = [x.split(")")[0] for x in plan(got).split("hashpartitioning(")[1:]]
    assert dealt and not [x for x in dealt if "sample" in x]
    none = sinks.pseudogenome(contigs.where("false"), snvs, spark.range(3).withColumnRenamed("id", "sample"))
    assert none.count() == 0


def test_profile_and_presence_of_overlapping_regions(spark):
    """Against plain medians and sums; for shares by time, pairs of sample and region are not shuffled."""
    rnd = random.Random(11)
    depth = {(s, p): rnd.choice([1, 1, 2, 3, 9]) for s in range(8) for p in range(50) if rnd.random() < (0.0, 0.04, 0.3, 0.45, 0.55, 0.7, 0.9, 1.0)[s]}
    spans = {100 * a + b: (a, b) for a in range(0, 56, 3) for b in range(a + 1, 60, 4)}
    cov = spark.createDataFrame([(s, p, c) for (s, p), c in depth.items()], "sample long, p long, cov long")
    regions = spark.createDataFrame([(r, a, b) for r, (a, b) in spans.items()], "region long, start long, end long")
    stats = spark.createDataFrame([(s, 0.0 if s == 2 else 1.5 + s) for s in range(7)], "sample long, mean double")
    mean = {r["sample"]: r["mean"] for r in stats.collect()}
    want = {}
    for r, (a, b) in spans.items():
        for s, m in mean.items():
            values = [depth.get((s, p), 0) for p in range(a, b)]
            # without a mean there is no ratio, and the cap is left of the last value
            ratio, median = (round(sum(values) / (b - a) / m, 9), min(round(statistics.median(values) / m), 4)) if m else (None, 4)
            want[r, s] = (ratio, round(sum(v > 0 for v in values) / (b - a), 9), median)
    profile = segments.region_profile(cov, regions, stats, width=16)
    got = {(r.region, r["sample"]): (None if r.mean_ratio is None else round(r.mean_ratio, 9), round(r.breadth, 9), r.median_ratio) for r in profile.collect()}
    assert got == want
    times = spark.createDataFrame([(s, s % 3) for s in range(8)], "sample long, time long")
    table = {}
    for (r, s), v in want.items():
        table.setdefault((r, s % 3), []).append(v[0])
    expected = {}
    for k, v in table.items():
        known = [x for x in v if x is not None]
        expected[k] = (len(v), round(sum((x or 0) > 0.2 for x in v) / len(v), 6), round(sum(known) / len(known), 6))
    presence = segments.region_presence(cov, regions, stats, times, min_ratio=0.2, width=16)
    assert {(r.region, r.time): (r.n, round(r.share_present, 6), round(r.avg_ratio, 6)) for r in presence.collect()} == expected
    dealt = [x.split(")")[0] for x in plan(presence).split("hashpartitioning(")[1:]]
    assert not [x for x in dealt if "region" in x and "sample" in x]
