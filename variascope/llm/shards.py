"""Shards of near-equal bytes from a k-d tree over metadata.

The tree starts with all rows and ``shards`` leaves. A node with k leaves is split along the metadata dimension in
which its rows spread widest (each dimension scaled to its range over the whole table), at the weighted quantile
floor(k / 2) / k of the row sizes, until every node is one leaf; the leaves are the shards.

A row's coordinate in a dimension is a whole number: the scaled value above 32 bits of a hash of the row, so rows
with the same value (a source with a third of all rows, copies of one text) still have an order and can be split
anywhere. Quantiles are found by refining histograms: one pass counts bytes in ``bins`` equal steps of every open
node, the step with the quantile becomes the next range, until it holds less than ``tolerance`` of a shard. Each pass
is one aggregation of a narrow table with map-side combining; the driver sees at most nodes * bins sums. The tree is
a column expression, so no level rewrites the table.

Slots number the rows of a shard from 0: rows are numbered inside (shard, input partition) and shifted by the counts
of earlier partitions, so no task holds a whole shard.

Defined cases: null metadata counts as the lowest value of its dimension, null text as 0 bytes; repeated rows are
told apart by their place in the input; with fewer rows than shards some shards stay empty; an empty table gives an
empty result; only the id, the text and the metadata columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variascope.llm.io import written

_SCALE = (1 << 31) - 1


@dataclass
class Node:
    """Leaves low .. high - 1; a split node has a dimension, a limit (left holds coordinates <= limit) and two sides."""

    low: int
    high: int
    dim: int = -1
    limit: int = 0
    left: Node | None = None
    right: Node | None = None

    def open(self) -> list[Node]:
        """Nodes without sides, in leaf order."""
        return [self] if self.left is None else [*self.left.open(), *self.right.open()]

    def column(self, names: list[str], number: dict[int, int]) -> Column:
        """Number of the open node of a row."""
        if self.left is None:
            return F.lit(number[self.low])
        test = F.col(names[self.dim]) <= F.lit(self.limit)
        return F.when(test, self.left.column(names, number)).otherwise(self.right.column(names, number))


def _value(field: T.StructField) -> Column:
    """A metadata column as a number that keeps its order (strings by their first six bytes)."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.NumericType):
        return column.cast("double")
    if isinstance(field.dataType, (T.DateType, T.TimestampType)):
        return column.cast("timestamp").cast("double")
    return F.conv(F.hex(F.rpad(F.substring(column.cast("string").cast("binary"), 1, 6), 6, F.lit(b"\0"))), 16, 10).cast("double")


def measured(docs: DataFrame, *, key: str, text: str, dims: list[str]) -> tuple[DataFrame, list[str]]:
    """Written narrow table (_row, _key, _size, _crc, coordinates) and the names of the coordinates."""
    values = {f"_d{k}": _value(docs.schema[d]) for k, d in enumerate(dims)}
    finite = {n: F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v) for n, v in values.items()}
    ends = docs.agg(*[f(finite[n]).alias(f"{n}_{s}") for n in values for s, f in (("min", F.min), ("max", F.max))]).first()
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(key).alias("_key"),
        (F.octet_length(whole) + 8).cast("long").alias("_size"),
        F.crc32(whole.cast("binary")).alias("_crc"),
        *[v.alias(n) for n, v in finite.items()],
    )
    tie = F.shiftrightunsigned(F.xxhash64("_row", "_key", "_crc"), 32)
    for n in values:
        low, high = ends[f"{n}_min"], ends[f"{n}_max"]
        scaled = F.lit(0.0) if low is None or high <= low else (F.col(n) - F.lit(low)) / F.lit(high - low) * F.lit(float(_SCALE))
        rows = rows.withColumn(n, F.coalesce(F.floor(scaled), F.lit(0)).cast("long") * F.lit(1 << 32) + tie)
    return written(rows, "measured"), list(values)


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def grow(rows: DataFrame, names: list[str], *, shards: int, bins: int, tolerance: float) -> Node:
    """The tree whose open nodes are the shards."""
    root = Node(0, shards)
    while any(n.high - n.low > 1 for n in root.open()):
        nodes = root.open()
        placed = rows.withColumn("_node", root.column(names, {n.low: k for k, n in enumerate(nodes)}))
        facts = {
            r["_node"]: r
            for r in placed.groupBy("_node")
            .agg(F.sum("_size").alias("bytes"), *[f(n).alias(f"{n}_{s}") for n in names for s, f in (("min", F.min), ("max", F.max))])
            .collect()  # one row per node
        }
        active = {}
        for k, node in enumerate(nodes):
            if node.high - node.low > 1:
                if k not in facts:
                    node.dim, node.limit = 0, -1
                    continue
                f = facts[k]
                node.dim = max(range(len(names)), key=lambda d: ((f[f"{names[d]}_max"] >> 32) - (f[f"{names[d]}_min"] >> 32), -d))
                half = (node.high - node.low) // 2
                share = f["bytes"] * half / (node.high - node.low)
                active[k] = [f[f"{names[node.dim]}_min"], f[f"{names[node.dim]}_max"], 0, share, f["bytes"] / (node.high - node.low)]
        while active:
            step = {k: max(1, -(-(high - low + 1) // bins)) for k, (low, high, *_) in active.items()}
            every = range(len(nodes))
            own = F.element_at(F.array(*[F.col(n) for n in names]), _pick([max(nodes[k].dim, 0) for k in every], F.col("_node")) + 1)
            lows = [active[k][0] if k in active else 1 for k in every]
            highs = [active[k][1] if k in active else 0 for k in every]
            steps = [step.get(k, 1) for k in every]
            counted = (
                placed.select("_node", "_size", own.alias("_at"), *[_pick(v, F.col("_node")).alias(n) for n, v in (("_low", lows), ("_high", highs), ("_step", steps))])
                .where("_at between _low and _high")
                .groupBy("_node", F.expr("(_at - _low) div _step").alias("_bin"))
                .agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"), F.max("_at").alias("last"))
                .collect()  # at most nodes * bins rows
            )
            by_node: dict[int, list] = {}
            for r in counted:
                by_node.setdefault(r["_node"], []).append(r)
            for k in list(active):
                low, high, before, target, leaf = active[k]
                for r in sorted(by_node[k], key=lambda r: r["first"]):
                    if before + r["bytes"] >= target or r["last"] == high:
                        break
                    before += r["bytes"]
                done = r["n"] == 1 or r["first"] == r["last"] or r["bytes"] <= tolerance * leaf
                if done:
                    over = before + r["bytes"] - target
                    nodes[k].limit = r["last"] if over <= target - before else r["first"] - 1
                    del active[k]
                else:
                    active[k] = [r["first"], r["last"], before, target, leaf]
        for node in nodes:
            if node.high - node.low > 1:
                middle = node.low + (node.high - node.low) // 2
                node.left, node.right = Node(node.low, middle), Node(middle, node.high)
    return root


def numbered(rows: DataFrame, shard: str = "shard", row: str = "_row") -> DataFrame:
    """``rows`` plus ``slot``: 0, 1, ... inside each shard, in input order."""
    parts = rows.withColumn("_part", F.shiftright(row, 33))
    inside = parts.withColumn("_n", F.row_number().over(Window.partitionBy(shard, "_part").orderBy(row)) - 1)
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_c"))
    shift = counts.select(shard, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    return inside.join(shift, [shard, "_part"]).withColumn("slot", (F.col("_n") + F.col("_before")).cast("long")).drop("_n", "_before", "_part")


def assign(
    docs: DataFrame,
    *,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
    dims: tuple[str, ...] = ("lang", "source", "n_chars", "doc_id"),
    bins: int = 1024,
    tolerance: float = 2e-4,
) -> DataFrame:
    """One row per document: _row (place in the input), id, size, text_crc32, shard, slot."""
    rows, names = measured(docs, key=key, text=text, dims=[d for d in dims if d in docs.columns])
    tree = grow(rows, names, shards=shards, bins=bins, tolerance=tolerance)
    leaf = tree.column(names, {n.low: n.low for n in tree.open()})
    placed = rows.select("_row", F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), leaf.alias("shard"))
    return numbered(placed)


def write(docs: DataFrame, path: str, *, shards: int, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Write the documents as one folder per shard and return the assignment.

    ``docs`` must be read from files: its rows are matched to the assignment by their place in the input.
    """
    placed = assign(docs, shards=shards, key=key, text=text, **options)
    (
        docs.withColumn("_row", F.monotonically_increasing_id())
        .join(placed.select("_row", "shard", "slot"), "_row")
        .drop("_row")
        .write.partitionBy("shard")
        .parquet(path)
    )
    return placed
