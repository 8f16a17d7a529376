"""Trees as intervals: a subtree is a range of places, a sum over it a difference of two running sums.

``Tree`` numbers the nodes of a forest in depth-first order. Subtree sizes and depths come from pointer doubling: in round
k every node knows its ancestor 2 ** k steps up, and hands the number of nodes that it has below it within 2 ** k steps to that
ancestor. A node's place is the sum, over its path to the root, of the sizes of earlier siblings, by doubling again. Every round
keeps one row per node and rounds are logarithmic in the depth, so a chain of 100 000 nodes takes 17 of them; nothing holds all
(node, ancestor) pairs. Siblings are summed in tiles, so a node with a third of all nodes as children is no single task.
Node tables are merged: every round would send one more of them through the driver if they were broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variascope.plans.lineage import stored
from variascope.plans.scan import running

#: Siblings, or places, in one tile of a running sum.
TILE = 1 << 16


def along_path(rows: DataFrame, *, node: str, up: str, values: dict[str, Callable[[Column, Column], Column]], keys: Sequence[str] = ()) -> DataFrame:
    """Fold ``values`` over the path of each (keys, node) to its root: ``values`` maps a column to (own, what is above) -> both.

    The functions must be associative. Two doublings are planned between two written tables.
    """

    def step(state: DataFrame) -> DataFrame:
        above = state.select(*keys, F.col(node).alias(up), F.col(up).alias("_next"), *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_has"))
        both = state.join(above.hint("merge"), [*keys, up], "left")
        folded = [F.when(F.col("_has"), fold(F.col(v), F.col(f"_{v}"))).otherwise(F.col(v)).alias(v) for v, fold in values.items()]
        return both.select(*keys, node, F.col("_next").alias(up), *folded)

    state = stored(rows.select(*keys, node, up, *values))
    while not state.where(F.col(up).isNotNull()).isEmpty():
        state = stored(step(step(state)))
    return state.drop(up)


class Tree:
    """Depth-first intervals of a forest given as (child, parent) rows; parents of roots are null.

    ``nodes``: node, parent, depth (0 for roots), enter, exit (exclusive); subtree of x = nodes with x.enter <= enter < x.exit.
    """

    def __init__(self, tree: DataFrame, *, child: str = "child", parent: str = "parent"):
        edges = stored(tree.select(F.col(child).alias("node"), F.col(parent).alias("up")))
        root = F.col("up").isNull()
        state = edges.withColumn("depth", F.when(root, 0).otherwise(1).cast("long")).withColumn("size", F.lit(1).cast("long"))
        self._lifts = []
        while not state.where("up IS NOT NULL").isEmpty():
            self._lifts.append(state.select("node", "up").where("up IS NOT NULL"))
            state = stored(self._doubled(self._doubled(state)))
        sized = stored(edges.join(state.select("node", "depth", "size").hint("merge"), "node"))
        shift = self._before(sized, F.lit(TILE))
        places = along_path(shift.select("node", "up", "place"), node="node", up="up", values={"place": lambda own, above: own + above + 1})
        self.nodes = stored(
            sized.join(places.hint("merge"), "node").select("node", F.col("up").alias("parent"), "depth", F.col("place").alias("enter"), (F.col("place") + F.col("size")).alias("exit"))
        )

    @staticmethod
    def _doubled(state: DataFrame) -> DataFrame:
        given = state.where("up IS NOT NULL").groupBy("up").agg(F.sum("size").alias("_more")).withColumnRenamed("up", "node")
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_next"), F.col("depth").alias("_depth"))
        both = state.join(above.hint("merge"), "up", "left").join(given.hint("merge"), "node", "left")
        none = F.lit(0).cast("long")
        return both.select(
            "node", F.col("_next").alias("up"), (F.col("depth") + F.coalesce("_depth", none)).alias("depth"), (F.col("size") + F.coalesce("_more", none)).alias("size")
        )

    @staticmethod
    def _before(sized: DataFrame, tile: Column) -> DataFrame:
        """(node, up, place): sum of the sizes of earlier siblings. Siblings are ordered by tile, then by node."""
        families = sized.groupBy("up").agg(F.count(F.lit(1)).alias("_n"))
        top = sized.where("up IS NULL").withColumn("_n", F.lit(sized.where("up IS NULL").count()))
        rows = sized.join(families.hint("merge"), "up").unionByName(top)
        # null parents (the roots) are one family, so joins compare a struct
        rows = rows.withColumn("_family", F.struct("up")).withColumn("_part", F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / tile)))
        return running(rows, keys=["_family"], order="node", tile=F.col("_part"), values={"place": ("sum", "size", False)})

    def subtree_sums(self, values: DataFrame, columns: Sequence[str]) -> DataFrame:
        """(node, columns): sums of ``values`` (node, columns; unique nodes) over each node's subtree, itself included."""
        own = self.nodes.join(values.select("node", *columns).hint("merge"), "node", "left").fillna(0, list(columns)).select("enter", *columns)
        sums = running(
            own, keys=[], order="enter", tile=F.floor(F.col("enter") / TILE), values={f"_{c}": ("sum", c, True) for c in columns}
        ).select("enter", *[F.col(f"_{c}").alias(c) for c in columns])
        sums = stored(sums)
        last = sums.select((F.col("enter") + 1).alias("exit"), *[F.col(c).alias(f"_{c}") for c in columns])
        before = sums.select((F.col("enter") + 1).alias("enter"), *columns)
        both = self.nodes.join(last.hint("merge"), "exit").join(before.hint("merge"), "enter", "left")
        return both.select("node", *[(F.col(f"_{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in columns])

    def meeting(self, pairs: DataFrame, *, first: str, last: str) -> DataFrame:
        """``pairs`` plus ``mrca`` and its ``depth``: the deepest node over the places of the nodes ``first`` and ``last``, of which ``first``
        enters first. From ``first`` up, every step is taken that stays below it. Null in different trees."""
        spans = self.nodes.select("node", "parent", "exit")
        place = self.nodes.select(F.col("node").alias(last), F.col("enter").alias("_to"))
        at = pairs.join(place.hint("merge"), last).join(spans.select(F.col("node").alias(first), F.col("exit").alias("_exit")).hint("merge"), first)
        at = at.withColumn("_at", F.col(first))
        for lift in reversed(self._lifts):
            over = lift.join(spans.select(F.col("node").alias("up"), F.col("exit").alias("_up_exit")).hint("merge"), "up").select(F.col("node").alias("_at"), "up", "_up_exit")
            for _ in range(3):
                low = F.col("_up_exit") <= F.col("_to")
                at = at.join(over.hint("merge"), "_at", "left").select(
                    *pairs.columns, "_to", F.when(low, F.col("up")).otherwise(F.col("_at")).alias("_at"), F.when(low, F.col("_up_exit")).otherwise(F.col("_exit")).alias("_exit")
                )
        tops = self.nodes.select(F.col("node").alias("_at"), "parent")
        found = at.join(tops.hint("merge"), "_at").withColumn("mrca", F.when(F.col("_exit") > F.col("_to"), F.col("_at")).otherwise(F.col("parent")))
        depths = self.nodes.select(F.col("node").alias("mrca"), "depth")
        return found.join(depths.hint("merge"), "mrca", "left").select(*pairs.columns, "mrca", "depth")

    def marked_above(self, marked: DataFrame) -> DataFrame:
        """(node, above): the closest proper ancestor of each node that is one of the nodes ``marked`` (node); null if none."""
        flags = self.nodes.join(marked.select("node", F.lit(True).alias("_mark")).distinct().hint("merge"), "node", "left")
        # a marked node ends the way of those below it
        own = flags.select("node", F.col("parent").alias("up"), F.coalesce("_mark", F.lit(False)).alias("_mark"))
        state = stored(own.join(own.select(F.col("node").alias("up"), F.col("_mark").alias("_over")).hint("merge"), "up", "left").select("node", "up", F.coalesce("_over", F.lit(True)).alias("_done")))
        while not state.where("NOT _done").isEmpty():
            above = state.select(F.col("node").alias("up"), F.col("up").alias("_next"), F.col("_done").alias("_over"))
            go = ~F.col("_done")
            state = stored(
                state.join(above.hint("merge"), "up", "left").select("node", F.when(go, F.col("_next")).otherwise(F.col("up")).alias("up"), (F.col("_done") | F.col("_over")).alias("_done"))
            )
        return state.select("node", F.col("up").alias("above"))
