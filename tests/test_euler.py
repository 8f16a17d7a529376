"""Depth-first intervals against plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from variascope.plans import euler
from variascope.plans.euler import Tree, along_path


def forest(kind, n=60):
    rnd = random.Random(4)
    if kind == "chain":
        return {k: k - 1 if k else None for k in range(n)}
    if kind == "star":
        return {k: 0 if k else None for k in range(n)}
    if kind == "forest":
        return {k: rnd.choice([None, *range(k)]) if k % 20 else None for k in range(n)}
    return {k: rnd.randrange(k) if k else None for k in range(n)}


def up(parent, x):
    out = []
    while x is not None:
        out.append(x)
        x = parent[x]
    return out


@pytest.mark.parametrize("kind", ["chain", "star", "forest", "random"])
def test_intervals_sums_and_meetings(spark, monkeypatch, kind):
    monkeypatch.setattr(euler, "TILE", 7)
    parent = forest(kind)
    tree = Tree(spark.createDataFrame([(k, p) for k, p in parent.items()], "child long, parent long"))
    rows = {r.node: r for r in tree.nodes.collect()}
    paths = {x: up(parent, x) for x in parent}
    assert sorted(r.enter for r in rows.values()) == list(range(len(parent)))
    for x in parent:
        assert rows[x].depth == len(paths[x]) - 1 and rows[x].parent == parent[x]
        assert {y for y in parent if rows[x].enter <= rows[y].enter < rows[x].exit} == {y for y in parent if x in paths[y]}
    values = spark.createDataFrame([(x, x * 3 % 11) for x in parent if x % 4], "node long, v long")
    assert {r.node: r.v for r in tree.subtree_sums(values, ["v"]).collect()} == {x: sum(y * 3 % 11 for y in parent if y % 4 and x in paths[y]) for x in parent}
    rnd = random.Random(9)
    pairs = [sorted(rnd.choices(list(parent), k=2), key=lambda x: rows[x].enter) for _ in range(60)]
    met = tree.meeting(spark.createDataFrame(pairs, "a long, b long"), first="a", last="b")
    for r in met.collect():
        common = [x for x in paths[r.a] if x in paths[r.b]]
        assert (r.mrca, r.depth) == ((common[0], len(paths[common[0]]) - 1) if common else (None, None))
    marks = {x for x in parent if x % 7 == 3}
    above = tree.marked_above(spark.createDataFrame([(x,) for x in marks], "node long"))
    assert {r.node: r.above for r in above.collect()} == {x: next((y for y in paths[x][1:] if y in marks), None) for x in parent}


def test_along_path_of_text_and_keys(spark):
    parent = forest("random", 25)
    rows = spark.createDataFrame([(g, str(k), None if p is None else str(p)) for g in (0, 1) for k, p in parent.items()], "g int, n string, p string")
    rows = rows.withColumn("label", F.concat("n", F.lit("/"), "g"))
    got = along_path(rows, node="n", up="p", values={"label": lambda own, above: F.concat(above, F.lit("; "), own)}, keys=["g"])
    assert {(r.g, r.n): r.label for r in got.collect()} == {(g, str(x)): "; ".join(f"{y}/{g}" for y in reversed(up(parent, x))) for g in (0, 1) for x in parent}


def test_deep_chain(spark):
    """No pairs of nodes and ancestors are kept: a chain of 10 000 nodes, with 50 million such pairs, takes few rounds."""
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("child"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    nodes = Tree(chain).nodes
    assert nodes.where("depth = node AND enter = node").where(F.col("exit") == n).count() == n
