"""Sample distances, lineages and edge-table trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variascope.functions.bases import BASES
from variascope.plans.components import components
from variascope.plans.euler import Tree, along_path
from variascope.plans.intervals import interval_join
from variascope.plans.lineage import cut
from variascope.plans.neighbours import PLANES, keys_pay, linked, nearest, nearest_of_all, pair_counts
from variascope.plans.packed import block_pairs, pack
from variascope.plans.scan import numbered


def _packed(calls: DataFrame, samples: DataFrame, *, n_sites: int, group: Sequence[str]) -> DataFrame:
    """Packed calls of every sample; samples without any call get zero planes."""
    zeros = F.array_repeat(F.lit(0).cast("long"), (n_sites + 63) // 64)
    rows = pack(calls, sample="sample", site="site", call="call", n_sites=n_sites, group=group)
    return samples.join(rows, [*group, "sample"], "left").select(
        *samples.columns, *[F.coalesce(c, zeros).alias(c) for c in PLANES]
    )


def _words(n_sites: int) -> int:
    return (n_sites + 63) // 64


def pairwise_snp(
    calls: DataFrame, samples: DataFrame, *, n_sites: int, group: Sequence[str] = (), n_blocks: int = 16
) -> DataFrame:
    """Differences and day gap for every sample pair of a group: the full pair table is the result.

    calls: group, sample, site (dense, 0-based), call. samples: group, sample, day.
    """
    rows = _packed(calls, samples, n_sites=n_sites, group=group)
    pairs = block_pairs(rows, key="sample", n_words=_words(n_sites), group=group, n_blocks=n_blocks)
    return pairs.select(
        *group,
        F.least("a.sample", "b.sample").alias("s1"),
        F.greatest("a.sample", "b.sample").alias("s2"),
        "snp_diff",
        F.abs(F.col("a.day") - F.col("b.day")).alias("time_diff"),
    )


def nearest_other_class(calls: DataFrame, samples: DataFrame, *, n_sites: int, group: Sequence[str] = ()) -> DataFrame:
    """For each sample with ``focal`` true the closest sample with ``focal`` false, ties to the smallest name.

    Neighbours are looked for within a growing number of differences; a sample that has found one is done, since its
    nearest one is among those found. Once keys would bring together as many pairs as there are, the samples left meet all
    others in blocks. Equal samples of one class are compared once.
    """
    rows = cut(_packed(calls, samples, n_sites=n_sites, group=group))
    distinct = cut(rows.groupBy(*group, "focal", *PLANES).agg(F.min("sample").alias("rep")))
    others, pending, found, reach = distinct.where("NOT focal"), distinct.where("focal"), None, 1
    while True:
        both, option = pending.unionByName(others), {"asks": "focal", "group": group}
        last = reach >= n_sites or not keys_pay(both, n_sites=n_sites, cutoff=reach, **option)
        near = nearest_of_all(both, who="rep", **option) if last else nearest(both, who="rep", n_sites=n_sites, cutoff=reach, **option)
        near = cut(near)
        found = near if found is None else found.unionByName(near)
        pending = pending.join(near, "rep", "left_anti")
        if last or pending.isEmpty():
            break
        reach = reach * 4 + 3
    days = samples.select(F.col("sample").alias("other"), F.col("day").alias("_day"))
    asking = rows.where("focal").join(distinct.where("focal"), [*group, *PLANES])
    return (
        asking.join(found, "rep")
        .join(days, "other")
        .select(*group, "sample", F.col("other").alias("nearest"), F.col("d").alias("snp_diff"), F.abs(F.col("day") - F.col("_day")).alias("time_diff"))
    )


def lineage_clusters(
    calls: DataFrame,
    samples: DataFrame,
    *,
    n_sites: int,
    cutoff: int = 30,
    analysed: Column | None = None,
) -> DataFrame:
    """Connected components of samples at most ``cutoff`` differences apart; singletons included.

    Samples with identical packed calls are one vertex: their mutual distance is 0 and their distances to others are
    equal, so only distinct vectors are compared and copies join their representative's component afterwards.
    With ``analysed`` only components that contain such a sample are kept.
    """
    rows = cut(_packed(calls, samples.select("sample"), n_sites=n_sites, group=()))
    distinct = cut(rows.groupBy(*PLANES).agg(F.min("sample").alias("rep")))
    near = linked(distinct, who="rep", n_sites=n_sites, cutoff=cutoff)
    found = components(distinct.select(F.col("rep").alias("v")), near)
    out = (
        rows.join(distinct, list(PLANES))
        .join(found.withColumnRenamed("v", "rep"), "rep")
        .select("sample", F.col("component").alias("lineage"))
    )
    if analysed is not None:
        kept = samples.where(analysed).select("sample").join(out, "sample").select("lineage").distinct()
        out = out.join(kept, "lineage", "left_semi").select("sample", "lineage")
    sizes = out.groupBy("lineage").agg(F.count(F.lit(1)).alias("size"))
    return out.join(sizes, "lineage").select("sample", "lineage", "size")


def pair_histogram(
    calls: DataFrame, samples: DataFrame, *, n_sites: int, group: Sequence[str] = (), fine_to: int = 30, coarse: int = 50
) -> DataFrame:
    """Pairs of a group by day gap and distance bin; pairs are counted in their task and never become rows."""
    rows = cut(_packed(calls, samples, n_sites=n_sites, group=group))
    counts = pair_counts(rows, who="sample", day="day", group=group)
    named = counts.withColumnsRenamed({"gap": "time_diff", "d": "snp_diff"})
    return distance_histogram(named, fine_to=fine_to, coarse=coarse, keys=[*group, "time_diff"], n="n")


def distance_histogram(pairs: DataFrame, *, fine_to: int = 30, coarse: int = 50, keys: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """Pair counts by distance bin: width 1 up to ``fine_to``, then width ``coarse``. A row stands for ``n`` pairs."""
    over = F.floor((F.col("snp_diff") - fine_to - 1) / coarse).cast("long")
    low = F.when(F.col("snp_diff") <= fine_to, F.col("snp_diff")).otherwise(over * coarse + fine_to + 1)
    return pairs.groupBy(*keys, low.alias("bin")).agg((F.sum(n) if n else F.count(F.lit(1))).alias("n"))


def tree_closure(tree: Tree, *, width: int = 4096) -> DataFrame:
    """(node, ancestor, steps) with steps from 0 (the node itself): every node with the intervals that it lies in."""
    over = tree.nodes.select(F.col("node").alias("ancestor"), F.col("depth").alias("_over"), F.col("enter").alias("_from"), F.col("exit").alias("_to"))
    inside = interval_join(tree.nodes.select("node", "depth", "enter"), over, point="enter", start="_from", end="_to", width=width)
    return inside.select("node", "ancestor", (F.col("depth") - F.col("_over")).alias("steps"))


def tips(tree: DataFrame) -> DataFrame:
    inner = tree.where(F.col("parent").isNotNull()).select(F.col("parent").alias("child")).distinct()
    return tree.join(inner.hint("merge"), "child", "left_anti").select(F.col("child").alias("node"))


def mrca(sets: DataFrame, tree: Tree) -> DataFrame:
    """Most recent common ancestor of every set (``set_id``, ``node``): that of its first and its last node in depth-first order."""
    placed = sets.join(tree.nodes.select("node", "enter"), "node")
    ends = placed.groupBy("set_id").agg(F.min_by("node", "enter").alias("_a"), F.max_by("node", "enter").alias("_b"), F.count(F.lit(1)).alias("n_tips"))
    return tree.meeting(ends, first="_a", last="_b").where("mrca IS NOT NULL").select("set_id", "mrca", "depth", "n_tips")


def tips_below(edges: DataFrame, tree: Tree) -> DataFrame:
    ones = tips(edges).withColumn("n_tips", F.lit(1).cast("long"))
    return tree.subtree_sums(ones, ["n_tips"]).select(F.col("node").alias("ancestor"), "n_tips")


def breadth_first_order(tree: Tree, *, tile_width: int = 1 << 16) -> DataFrame:
    """(node, depth, place in its level), by node number in the level; a level is numbered in tiles."""
    nodes = tree.nodes.select("node", "depth")
    placed = numbered(nodes, keys=["depth"], order=[F.col("node")], tile=F.floor(F.col("node") / tile_width))
    return placed.select("node", "depth", F.col("rn").cast("int").alias("place"))


def edge_changes(tree: DataFrame, node_calls: DataFrame, *, skip_tips: bool = False) -> DataFrame:
    """Changes along edges, unknown bases ignored: (site, node, parent, from_nt, to_nt).

    Calls are merged, never broadcast: rows made by an explode are not in the size estimate of their table.
    """
    edges = tree.where(F.col("parent").isNotNull()).select("child", "parent")
    if skip_tips:
        edges = edges.join(tips(tree).select(F.col("node").alias("child")), "child", "left_anti")
    below = node_calls.select(F.col("node").alias("child"), "site", F.col("nt").alias("to_nt")).hint("merge")
    above = node_calls.select(F.col("node").alias("parent"), "site", F.col("nt").alias("from_nt")).hint("merge")
    return (
        edges.join(below, "child")
        .join(above, ["parent", "site"])
        .where((F.col("to_nt") != F.col("from_nt")) & (F.col("to_nt") != "N") & (F.col("from_nt") != "N"))
        .select("site", F.col("child").alias("node"), "parent", "from_nt", "to_nt")
    )


def events_per_site(changes: DataFrame, sites: DataFrame) -> DataFrame:
    counts = changes.groupBy("site").agg(F.count(F.lit(1)).alias("events"))
    return sites.select("site").distinct().join(counts, "site", "left").fillna(0, ["events"])


def homoplasy_nearest(changes: DataFrame, closure: DataFrame) -> DataFrame:
    """For every changed node the nearest other node with the same change at the same site, by path length.

    No pairs are formed. Under each ancestor only the two shallowest hit nodes matter: the path to the nearest
    partner is the minimum over ancestors of both climbs, and an ancestor above the common one only overestimates.
    The two shallowest come from ``row_number <= 2``, which Spark limits before the shuffle.
    """
    hits = changes.select("site", "to_nt", "node")
    above = hits.join(closure, "node")
    order = Window.partitionBy("site", "to_nt", "ancestor").orderBy("steps", "node")
    best = above.withColumn("rn", F.row_number().over(order)).where("rn <= 2").select(
        "site", "to_nt", "ancestor", F.col("node").alias("other"), F.col("steps").alias("other_steps")
    )
    return (
        above.join(best, ["site", "to_nt", "ancestor"])
        .where(F.col("node") != F.col("other"))
        .groupBy("site", "to_nt", "node")
        .agg(F.min(F.struct((F.col("steps") + F.col("other_steps")).alias("path"), "other")).alias("m"))
        .select("site", "to_nt", "node", F.col("m.other").alias("nearest"), F.col("m.path").alias("path"))
    )


def node_differences(pairs: DataFrame, node_calls: DataFrame, *, n_sites: int, a: str = "node", b: str = "nearest") -> DataFrame:
    """Number of sites where two nodes differ (unknown counts as its own symbol), from packed calls."""
    idx = F.call_function("instr", F.lit(BASES), F.col("nt"))
    packed = pack(
        node_calls.select(F.col("node").alias("sample"), "site", F.when(idx > 0, (idx - 1).cast("int")).alias("call")),
        sample="sample", site="site", call="call", n_sites=n_sites,
    )
    words = _words(n_sites)
    left = packed.select(F.col("sample").alias(a), F.struct("lo", "hi", "seen").alias("_a"))
    right = packed.select(F.col("sample").alias(b), F.struct("lo", "hi", "seen").alias("_b"))

    def word(i: int) -> Column:
        def get(side: str, plane: str) -> Column:
            return F.get(F.col(f"{side}.{plane}"), F.lit(i))

        both = get("_a", "seen").bitwiseAND(get("_b", "seen"))
        changed = get("_a", "lo").bitwiseXOR(get("_b", "lo")).bitwiseOR(get("_a", "hi").bitwiseXOR(get("_b", "hi")))
        one = get("_a", "seen").bitwiseXOR(get("_b", "seen"))
        return F.bit_count(changed.bitwiseAND(both)) + F.bit_count(one)

    total = word(0)
    for i in range(1, words):
        total = total + word(i)
    return pairs.join(left, a).join(right, b).withColumn("differences", total.cast("long")).drop("_a", "_b")


def homoplasy_support(changes: DataFrame, support: DataFrame, *, min_support: float) -> DataFrame:
    """Events per site minus those whose parent node is poorly supported; only sites with several events."""
    rows = changes.join(support.select(F.col("node").alias("parent"), "support"), "parent", "left")
    per_site = rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("support") < min_support).alias("weak")
    )
    return per_site.where("events > 1").withColumn("supported", F.col("events") - F.col("weak"))


# The six strand-folded substitution classes and their kind.
FOLDED = {"TA": "TA", "AT": "TA", "TC": "TC", "AG": "TC", "TG": "TG", "AC": "TG", "CA": "CA", "GT": "CA", "CT": "CT", "GA": "CT", "CG": "CG", "GC": "CG"}
CLASSES = ("TA", "TC", "TG", "CA", "CT", "CG")
# The twelve directed substitutions.
SUBSTITUTIONS = ("AT", "AG", "AC", "TA", "TG", "TC", "GA", "GT", "GC", "CA", "CT", "CG")


def folded_class(from_nt: Column, to_nt: Column) -> Column:
    pair = F.concat(from_nt, to_nt)
    out = None
    for cls in CLASSES:
        members = [k for k, v in FOLDED.items() if v == cls]
        out = F.when(pair.isin(members), cls) if out is None else out.when(pair.isin(members), cls)
    return out


def spectrum_per_subtree(changes: DataFrame, tree: Tree, edges: DataFrame) -> DataFrame:
    """Folded substitution counts and shares summed over each internal node's subtree.

    Changes are counted per node and class; subtree sums are differences of running sums along the depth-first order.
    """
    cls = folded_class(F.col("from_nt"), F.col("to_nt"))
    per_node = changes.withColumn("cls", cls).groupBy("node").agg(*[F.count_if(F.col("cls") == c).alias(c) for c in CLASSES])
    inner = edges.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
    rows = tree.subtree_sums(per_node, CLASSES).join(inner, "node", "left_semi")
    total = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    return rows.select(
        "node",
        total.cast("long").alias("total"),
        *[F.when(total > 0, F.col(c) / total).otherwise(F.lit(0.0)).alias(c) for c in CLASSES],
    )


def closest_ancestor_genotype(sets: DataFrame, tree: Tree, *, root: str = "root") -> DataFrame:
    """Parent genotype of every genotype (set_id, node): the one whose MRCA is the deepest proper ancestor.

    Siblings are refined: a genotype whose carriers are a proper subset of a sibling's becomes that sibling's child
    (the smallest such sibling). Containment is counted over shared carriers, so unrelated genotypes never meet.
    """
    found = cut(mrca(sets, tree))
    first = found.groupBy(F.col("mrca").alias("above")).agg(F.min("set_id").cast("string").alias("parent"))
    above = tree.marked_above(found.select(F.col("mrca").alias("node"))).where("above IS NOT NULL").join(first.hint("merge"), "above")
    base = found.select("set_id", "n_tips", "mrca").join(above.select(F.col("node").alias("mrca"), "parent").hint("merge"), "mrca", "left")
    base = base.select("set_id", "n_tips", F.coalesce("parent", F.lit(root)).alias("parent"))
    tagged = sets.join(base.hint("merge"), "set_id")
    small = tagged.select("node", "parent", F.col("set_id").alias("s"), F.col("n_tips").alias("ns"))
    large = tagged.select("node", "parent", F.col("set_id").alias("l"), F.col("n_tips").alias("nl"))
    nested = (
        small.join(large.hint("merge"), ["node", "parent"])
        .where("ns < nl")
        .groupBy("s", "l", "ns", "nl")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where("shared = ns")
        .groupBy("s")
        .agg(F.min(F.struct("nl", "l")).alias("m"))
        .select(F.col("s").alias("set_id"), F.col("m.l").cast("string").alias("finer"))
    )
    return base.join(nested.hint("merge"), "set_id", "left").select("set_id", F.coalesce("finer", "parent").alias("parent"))


def genotype_chain(parents: DataFrame, *, root: str = "root") -> DataFrame:
    """Label of a genotype: all genotypes on the way from the root, joined in that order."""
    own = F.col("set_id").cast("string")
    rows = parents.select(own.alias("set_id"), F.when(F.col("parent") != root, F.col("parent")).alias("parent"), own.alias("chain"))
    return along_path(rows, node="set_id", up="parent", values={"chain": lambda mine, above: F.concat(above, F.lit("; "), mine)})


def linked_mutations(carriers: DataFrame) -> DataFrame:
    """(mutation, first, n): mutations carried by exactly the same samples share their smallest one and their number.

    A set of samples is known by its size and two order-free sums of 64-bit hashes, so neither carriers nor members are
    collected, however many share a set.
    """
    prints = carriers.select("mutation", "sample").distinct().groupBy("mutation").agg(
        F.count(F.lit(1)).alias("_k"), F.bit_xor(F.xxhash64("sample")).alias("_x"), F.bit_xor(F.xxhash64("sample", F.lit(1))).alias("_y")
    )
    key = ["_k", "_x", "_y"]
    groups = prints.groupBy(*key).agg(F.min("mutation").alias("first"), F.count(F.lit(1)).alias("n"))
    return prints.join(groups, key).select("mutation", "first", "n")


def linked_carriers(carriers: DataFrame, linked: DataFrame) -> DataFrame:
    """(first, n, sample): the samples of each group of linked mutations, read off its first mutation."""
    heads = linked.where("mutation = first").select("mutation", "n")
    return carriers.select("mutation", "sample").distinct().join(heads, "mutation").select(F.col("mutation").alias("first"), "n", "sample")


def substitution_spectrum(observed: DataFrame) -> DataFrame:
    """Share of the twelve substitutions, each observed (anc, alt) counted in both directions."""
    alleles = observed.where((F.col("nt") != F.col("anc")) & F.col("nt").isin(*BASES) & F.col("anc").isin(*BASES)).select(
        "site", "anc", "nt"
    ).distinct()
    both = alleles.select(F.concat("anc", "nt").alias("sub")).unionByName(alleles.select(F.concat("nt", "anc").alias("sub")))
    counts = both.groupBy("sub").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("sub", "n", (F.col("n") / total).alias("share"))


def differences_to_root(calls: DataFrame, ancestor: DataFrame) -> DataFrame:
    """Known calls that differ from the ancestral sequence, per sample."""
    return calls.join(ancestor, "site").groupBy("sample").agg(
        F.count_if(F.col("call").isNotNull() & (F.col("call") != F.col("anc"))).alias("differences")
    )
