"""Plan helpers against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from variascope.plans.components import components
from variascope.plans.grid import filled
from variascope.plans.intervals import interval_join, last_at_or_before, overlap_join
from variascope.plans.packed import block_pairs, pack
from variascope.plans.scan import islands, merge_intervals, numbered, running, value_ranks


def test_running_equals_loop(spark):
    rnd = random.Random(1)
    rows = [(k, o, rnd.randint(-5, 9)) for k in "ab" for o in rnd.sample(range(500), 80)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = running(
        df, keys=["k"], order="o", tile=F.floor(F.col("o") / 37),
        values={"s": ("sum", "v", True), "m": ("max", "v", False)},
    ).collect()
    for r in got:
        before = [v for k, o, v in rows if k == r.k and o < r.o]
        assert r.s == sum(before) + r.v
        assert r.m == (max(before) if before else None)


@pytest.mark.parametrize("width", [3, 10, 1000])
def test_islands_do_not_depend_on_tiles(spark, width):
    rnd = random.Random(2)
    spots = sorted(rnd.sample(range(120), 80))
    df = spark.createDataFrame([("x", p) for p in spots], "s string, p long")
    want, start = set(), None
    for i, p in enumerate(spots):
        start = p if start is None else start
        if i + 1 == len(spots) or spots[i + 1] != p + 1:
            want.add((start, p + 1))
            start = None
    assert {(r.start, r.end) for r in islands(df, keys=["s"], position="p", tile_width=width).collect()} == want


@pytest.mark.parametrize("overlap", [0, 3])
def test_merge_intervals_equals_loop(spark, overlap):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), s, s + rnd.randint(1, 12)) for s in (rnd.randrange(300) for _ in range(70))]
    want = {}
    for k, s, e in sorted(rows):
        regions = want.setdefault(k, [])
        if regions and regions[-1][1] - overlap > s:
            regions[-1][1] = max(regions[-1][1], e)
        else:
            regions.append([s, e])
    df = spark.createDataFrame(rows, "k string, s long, e long")
    got = merge_intervals(df, keys=["k"], start="s", end="e", overlap=overlap, tile_width=20).collect()
    # Rows with equal starts are one row here, so ends are compared through starts only when overlap is 0.
    if overlap == 0:
        assert {(r.k, r.region_start, r.region_end) for r in got} == {(k, s, e) for k, v in want.items() for s, e in v}
    assert sum(r.members for r in got) == len(rows)


def test_joins_equal_brute_force(spark):
    rnd = random.Random(4)
    points = [(i, rnd.randrange(1000)) for i in range(100)]
    spans = [(j, s, s + rnd.randrange(200)) for j, s in enumerate(rnd.sample(range(900), 40))]
    p = spark.createDataFrame(points, "i long, p long")
    g = spark.createDataFrame(spans, "j long, s long, e long")
    want = {(i, j) for i, x in points for j, s, e in spans if s <= x < e}
    for salt in (1, 4):
        got = interval_join(p, g, point="p", start="s", end="e", width=64, salt=salt)
        assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)
    anti = interval_join(p, g, point="p", start="s", end="e", width=64, how="left_anti").collect()
    assert {r.i for r in anti} == {i for i, _ in points} - {i for i, _ in want}
    h = spark.createDataFrame(spans, "k long, a long, b long")
    both = overlap_join(g, h, a_start="s", a_end="e", b_start="a", b_end="b", width=64).collect()
    pairs = {(j, k) for j, s, e in spans for k, a, b in spans if s < b and a < e and s < e and a < b}
    assert sorted((r.j, r.k) for r in both) == sorted(pairs)
    asof = last_at_or_before(p, g.select("j", "s"), point="p", anchor="s", width=64).collect()
    for r in asof:
        best = max(((s, j) for j, s, _ in spans if s <= r.p), default=(None, None))
        assert (r.s, r.j) == best


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 3)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 12)], "v long")
    got = {r.v: r.component for r in components(nodes, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 5, 10: 10, 11: 11}


def test_packed_pairs(spark):
    rnd = random.Random(5)
    calls = [(s, p, rnd.choice([0, 1, 2, 3, None])) for s in range(9) for p in range(150)]
    df = spark.createDataFrame(calls, "s long, p long, c int")
    packed = pack(df, sample="s", site="p", call="c", n_sites=150)
    got = {(min(r.a.s, r.b.s), max(r.a.s, r.b.s)): r.snp_diff for r in block_pairs(packed, key="s", n_words=3, n_blocks=4).collect()}
    by = {(s, p): c for s, p, c in calls}
    for a in range(9):
        for b in range(a + 1, 9):
            assert got[(a, b)] == sum(
                by[a, p] is not None and by[b, p] is not None and by[a, p] != by[b, p] for p in range(150)
            )
    assert len(got) == 36


def test_numbering_ranks_and_absent_pairs(spark):
    rnd = random.Random(6)
    rows = [("k", rnd.randrange(30)) for _ in range(100)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = numbered(df, keys=["k"], order=[F.col("v")], tile=F.floor(F.col("v") / 7)).collect()
    assert sorted(r.rn for r in got) == list(range(1, 101))
    assert [r.v for r in sorted(got, key=lambda r: r.rn)] == sorted(v for _, v in rows)
    for r in value_ranks(df, keys=["k"], value="v").collect():
        assert r.below == sum(v < r.v for _, v in rows)
    a = spark.range(7).select(F.col("id").alias("x"))
    b = spark.range(11).select((F.col("id") * 3).cast("string").alias("y"))
    there = a.where("x % 2 = 0").select("x", F.lit("9").alias("y"), F.lit(1).alias("v")).unionByName(a.where("x = 3").select("x", F.lit("0").alias("y"), F.lit(2).alias("v")))
    for tile in (3, 100):
        got = [(r.x, r.y, r.v) for r in filled(there, a, b, key="x", item="y", tile=tile).collect()]
        assert sorted(got, key=str) == sorted([(x, str(y * 3), 1 if y == 3 and x % 2 == 0 else 2 if (x, y) == (3, 0) else None) for x in range(7) for y in range(11)], key=str)
    assert filled(there, a, b.where("false"), key="x", item="y").count() == 5
