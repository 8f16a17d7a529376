"""N-gram Jaccard join: which texts have nearly the same set of n-word shingles, by walking prefix trees.

Sets are kept in one global order, that of their shingle hashes. Texts with equal sets are one class; its smallest id goes on.

1. Who can match at all. A set of n shingles lacks at most a = n - ceil(s n) of its own in a partner of similarity s. So of
   its first a + slack(n) shingles, ``need`` at least are also among the first shingles of the partner. Shingles are
   counted over all documents (map-side combined), those of one document drop out, and so do documents with fewer than
   ``need`` left. Most documents end here, and also those that share only a common passage.
2. Keys. Of the r shingles that a document has left, the r - need + 1 rarest hold one that the partner has among its own
   rarest, so pairs meet at these keys. Keys are not expanded into pairs of rows: every member meets the smallest member of
   its key first, linked members become one component, and a key with one component is done. In the last turn, all
   members outside a key's first component meet all of other components: members are dealt in blocks, keys with the
   same members are one, and a task returns those pairs of two blocks whose sizes and parity bits allow the similarity
   (bits that differ are as many members of one set only, at least).
3. The join. A unit of work has the sets that a probe is to meet. They make a trie, so sets with the same beginning share
   a path. All probes of a task walk down together, level by level; the overlap of a probe with a path is counted once for
   all sets below. A subtree is left when its sizes cannot match, when all its sets are in the probe's component, or when the
   overlap plus the shingles that both sides have left can no longer reach the similarity. At the end of a path the overlap is
   exact.

No pair is dropped but by these bounds, so every link between different sets is found or lies within a component.

Defined cases: null and empty texts and texts without words have an empty set and link nothing; a text of fewer words than
``size`` is one shingle; every row gives one row; ids are meant to be unique, different texts under one id count as
linked through it and one of them is compared; rows with a null id have no component; an empty table gives an empty
result; only id and text are read. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variascope.llm import bloom
from variascope.llm.io import written
from variascope.llm.near import shingles
from variascope.llm.words import lists, map_columns, mix, pack, ragged, slices
from variascope.plans.components import components

#: Parity bits of a set.
_PARITY = 2048
#: Shingles in a unit's stored sets, and in one task; turns before the last one; path length of one step; states of a
#: walk that are worked on at once; members of a key in a block of the last turn, and in one task.
_BLOCK, _TASK, _TURNS, _SEGMENT, _STATES = 250_000, 1_000_000, 1, 32, 50_000
_MEMBERS, _ROWS = 2_000, 50_000


def slack(n, percent: int):
    """Shingles beyond the prefix that is needed for one common shingle; grows with n, works on arrays and columns."""
    half = n * (100 - percent)
    return (half.cast("long") / 200).cast("long") + 1 if isinstance(n, Column) else half // 200 + 1


def smallest_partner(n, percent: int):
    """ceil(n * percent / 100)."""
    return F.ceil(n * percent / 100) if isinstance(n, Column) else -(-n * percent // 100)


def sketches(docs: DataFrame, *, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Written table (_id, n, p1, p2, low): set size, two sums that identify the set, and its first shingles in global order."""
    longs = ("n", "p1", "p2")
    added = T.StructType([*[T.StructField(c, T.LongType()) for c in longs], T.StructField("low", T.ArrayType(T.LongType()))])

    def make(column):
        data, offsets = pack(column)
        parts = []
        for i, j in slices(offsets):
            values, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            n = np.diff(first)
            sums = [np.concatenate([[0], np.cumsum(mix(values ^ np.uint64(salt)))]) for salt in (0, 0xA5A5A5A5A5A5A5A5)]
            prints = [(s.astype(np.uint64)[first[1:]] - s.astype(np.uint64)[first[:-1]]).view(np.int64) for s in sums]
            kept = np.where(n > 0, n - smallest_partner(n, percent) + slack(n, percent), 0)
            parts.append((n, *prints, kept, values[ragged(first[:-1], kept)].view(np.int64)))
        if not parts:
            return [*[pa.array([], pa.int64()) for _ in longs], pa.array([], pa.list_(pa.int64()))]
        *facts, kept, low = (np.concatenate(v) for v in zip(*parts))
        return [*(pa.array(v.astype(np.int64)) for v in facts), lists(pa.array(low), kept)]

    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    return written(map_columns(rows, "_text", make, added, ["_id"]), "sketches")


def representatives(made: DataFrame, least: DataFrame) -> DataFrame:
    """(_id, low) of the rows that stand for their class. A Bloom filter of the few other rows' ids keeps the shingles of most
    rows out of a shuffle."""
    facts = ["_id", "n", "p1", "p2"]
    some = made.where("n > 0 and _id is not null")
    copies = written(some.select(*facts).join(least, facts, "left_anti").distinct(), "copies")
    bits = bloom.bits_for(copies.count())
    flagged = bloom.flag(some, "_id", bloom.present(copies, "_id", bits), bits, "_maybe")
    return flagged.where("not _maybe").select("_id", "low").unionByName(flagged.where("_maybe").join(copies, facts, "left_anti").select("_id", "low"))


def matchable(same: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Written keys (token, _id, n): pairs of the classes ``same`` (_id, low) of ``sizes`` (_id, n) that can be similar have one in common."""
    need = slack(smallest_partner(F.col("n"), percent), percent)
    rows = same.select("_id", F.explode("low").alias("token"))
    common = rows.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    mine = Window.partitionBy("_id")
    hits = rows.join(common, "token").join(sizes, "_id")
    ranked = hits.withColumns({"r": F.count(F.lit(1)).over(mine), "k": F.row_number().over(mine.orderBy("many", "token"))})
    keys = written(ranked.where((F.col("r") >= need) & (F.col("k") <= F.col("r") - need + 1)).select("token", "_id", "n"), "ranked")
    shared = keys.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    return written(keys.join(shared.select("token"), "token"), "keys")


def parity(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bit h of a row is the parity of its shingles that hash to h."""
    rows = len(first) - 1
    owner = np.repeat(np.arange(rows), np.diff(first))
    odd = np.bincount(owner * _PARITY + (mix(values) >> np.uint64(32)).astype(np.int64) % _PARITY, minlength=rows * _PARITY) & 1
    return np.packbits(odd.astype(bool).reshape(rows, _PARITY), axis=1).view(np.int64)


def full_sets(docs: DataFrame, ids: DataFrame, *, key: str, text: str, size: int) -> DataFrame:
    """Written table (_id, bits, tokens) of the documents in ``ids``, and a few more: parity bits, and all shingles in global
    order. Texts are not shuffled: a Bloom filter of the ids of bounded size finds them where they are read."""
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where(F.col(key).isNotNull())
    rows = maybe_among(rows, ids)
    longs = T.ArrayType(T.LongType())

    def make(column):
        data, offsets = pack(column)
        parts = [shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size) for i, j in slices(offsets)]
        values = np.concatenate([np.zeros(0, np.uint64), *[p[0] for p in parts]])
        bits = np.concatenate([np.zeros((0, _PARITY // 64), np.int64), *[parity(*p) for p in parts]])
        sizes = np.concatenate([np.zeros(0, np.int64), *[np.diff(p[1]) for p in parts]])
        return [lists(pa.array(bits.ravel()), np.full(len(bits), _PARITY // 64)), lists(pa.array(values.view(np.int64)), sizes)]

    return written(map_columns(rows, "_text", make, T.StructType([T.StructField("bits", longs), T.StructField("tokens", longs)]), ["_id"]), "sets")


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose _id is in ``ids`` (distinct): a Bloom filter of bounded size keeps most others from the shuffle."""
    return maybe_among(rows, ids).join(ids, "_id", "left_semi")


def maybe_among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose _id is in ``ids``, and some others."""
    bits = bloom.bits_for(ids.count())
    return bloom.flag(rows, "_id", bloom.present(ids, "_id", bits), bits, "_maybe").where("_maybe").select(*rows.columns)


class Trie:
    """Compressed tries of sets, one per unit; node k covers the path from its parent's depth to its own."""

    def __init__(self, unit: np.ndarray, offsets: np.ndarray, tokens: np.ndarray, group: np.ndarray):
        """``tokens``: ascending numbers of each set; ``group``: the component of each set."""
        paths = tokens.astype(">u4")
        cuts = [paths[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        self.roots: dict[int, int] = {}
        depth, parent, owner, ends = [], [], [], []
        stack: list[int] = []
        last = -1
        for s in sorted(range(len(cuts)), key=lambda s: (unit[s], cuts[s])):
            shared = 0
            if int(unit[s]) not in self.roots:
                self.roots[int(unit[s])] = len(depth)
                stack = [len(depth)]
                depth.append(0), parent.append(-1), owner.append(s), ends.append(-1)
            else:
                n = min(offsets[s + 1] - offsets[s], offsets[last + 1] - offsets[last])
                other = np.flatnonzero(tokens[offsets[s] : offsets[s] + n] != tokens[offsets[last] : offsets[last] + n])
                shared = int(other[0]) if len(other) else int(n)
            below = -1
            while depth[stack[-1]] > shared:
                below = stack.pop()
            if depth[stack[-1]] < shared:
                depth.append(shared), parent.append(stack[-1]), owner.append(s), ends.append(-1)
                parent[below] = len(depth) - 1
                stack.append(len(depth) - 1)
            depth.append(int(offsets[s + 1] - offsets[s])), parent.append(stack[-1]), owner.append(s), ends.append(s)
            stack.append(len(depth) - 1)
            last = s
        self.depth, self.parent, self.ends = (np.array(v, np.int64) for v in (depth, parent, ends))
        self.start = offsets[np.array(owner, np.int64)] if owner else np.zeros(0, np.int64)  # of a set with this path
        self.tokens = tokens
        order = np.argsort(self.parent, kind="stable")
        self.children = order
        self.first = np.searchsorted(self.parent[order], np.arange(len(depth) + 1))
        self._bounds(np.diff(offsets), group)

    def _bounds(self, sizes: np.ndarray, group: np.ndarray):
        """Smallest and largest set size and smallest and largest component below each node."""
        most = np.iinfo(np.int64).max
        leaf = self.ends >= 0
        at = self.ends[leaf]
        self.least, self.most, self.low, self.high = (np.full(len(leaf), v) for v in (most, -1, most, -1))
        for name, value in (("least", sizes), ("most", sizes), ("low", group), ("high", group)):
            getattr(self, name)[leaf] = value[at]
        level, levels = np.array(list(self.roots.values()), np.int64), []
        while len(level):
            levels.append(level)
            level = self.children[ragged(self.first[level], self.first[level + 1] - self.first[level])]
        for level in reversed(levels[1:]):
            up = self.parent[level]
            for name, put in (("least", np.minimum), ("most", np.maximum), ("low", np.minimum), ("high", np.maximum)):
                put.at(getattr(self, name), up, getattr(self, name)[level])

    def walk(self, unit: np.ndarray, offsets: np.ndarray, tokens: np.ndarray, group: np.ndarray, percent: int):
        """(probe, set) pairs of different components with the similarity; probes are given like sets."""
        sizes = np.diff(offsets)
        span = int(max(tokens.max(initial=0), self.tokens.max(initial=0))) + 1
        known = np.repeat(np.arange(len(sizes)), sizes) * span + tokens
        probe = np.flatnonzero([int(u) in self.roots for u in unit])
        node = np.array([self.roots[int(unit[p])] for p in probe], np.int64)
        at, overlap = np.zeros(len(probe), np.int64), np.zeros(len(probe), np.int64)
        out, pending = [], [(probe, node, at, overlap)]
        while pending:
            probe, node, at, overlap = states = pending.pop()
            # states at the end of their node's path go to its children
            over = at == self.depth[node]
            many = np.where(over, self.first[node + 1] - self.first[node], 1)
            if many.sum() > _STATES and len(many) > 1:
                half = len(many) // 2
                pending += [tuple(v[half:] for v in states), tuple(v[:half] for v in states)]
                continue
            end = over & (self.ends[node] >= 0)
            p, s = probe[end], self.ends[node[end]]
            union = sizes[p] + self.depth[node[end]] - overlap[end]
            good = (100 * overlap[end] >= percent * union) & (self.low[node[end]] >= 0)
            out.append((p[good], s[good]))
            which = np.repeat(np.arange(len(node)), many)
            below = node[which]
            fan = over[which]
            below[fan] = self.children[ragged(self.first[node[over]], many[over])]
            probe, node, at, overlap = probe[which], below, at[which], overlap[which]
            # sizes that fit, and another component below
            n = sizes[probe]
            fits = (100 * self.most[node] >= percent * n) & (percent * self.least[node] <= 100 * n)
            fits &= (self.low[node] != group[probe]) | (self.high[node] != group[probe])
            probe, node, at, overlap = probe[fits], node[fits], at[fits], overlap[fits]
            # the next part of the path
            step = np.minimum(self.depth[node] - at, _SEGMENT)
            path = self.tokens[ragged(self.start[node] + at, step)]
            wanted = np.repeat(probe, step) * span + path
            found = np.searchsorted(known, wanted)
            hit = np.zeros(len(path) + 1, np.int64)
            hit[1:] = known[np.minimum(found, len(known) - 1)] == wanted if len(known) else 0
            hit = np.cumsum(hit)
            stop = np.cumsum(step)
            overlap = overlap + hit[stop] - hit[stop - step]
            at = at + step
            some = step > 0
            passed = np.zeros(len(probe), np.int64)
            passed[some] = found[stop[some] - 1] + (hit[stop[some]] - hit[stop[some] - 1]) - offsets[probe[some]]
            # overlap is at most that so far and what both sides have left; the best size makes both equal
            n = sizes[probe]
            left = n - passed
            size = np.clip(at + left, self.least[node], self.most[node])
            bound = overlap + np.minimum(left, size - at)
            alive = 100 * bound >= percent * (n + size - bound)
            if alive.any():
                pending.append((probe[alive], node[alive], at[alive], overlap[alive]))
        p, s = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return p, s


def _join(table: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) of one task: rows (unit, probe, _id, c, tokens)."""
    table = table.combine_chunks()
    tokens = table.column("tokens").combine_chunks()
    sizes = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    _, values = np.unique(values, return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    _, unit = np.unique(table.column("unit").to_numpy(), return_inverse=True)
    _, group = np.unique(table.column("c").to_numpy(zero_copy_only=False), return_inverse=True)
    probing = table.column("probe").to_numpy(zero_copy_only=False).astype(bool)
    sides = []
    for rows in (np.flatnonzero(~probing), np.flatnonzero(probing)):
        cuts = np.concatenate([[0], np.cumsum(sizes[rows])]).astype(np.int64)
        sides.append((rows, unit[rows], cuts, values[ragged(begin[rows], sizes[rows])].astype(np.int64), group[rows]))
    (stored, *sets), (probes, *asked) = sides
    p, s = Trie(*sets).walk(*asked, percent)
    ids = table.column("_id").combine_chunks()
    return pa.table({"a": ids.take(pa.array(probes[p])), "b": ids.take(pa.array(stored[s]))})


def joined(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written links (a, b) of units (unit, probe, _id, n, c): probes against the stored sets of the same unit."""
    units = written(units, "units")
    total = units.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-int(total) // _TASK))
    needed = among(sets.select("_id", "tokens"), units.select("_id").distinct())
    rows = units.join(needed, "_id").withColumn("task", F.pmod(F.xxhash64("unit"), F.lit(tasks)))
    kind = units.schema["_id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    rows = rows.select("task", "unit", "probe", "_id", "c", "tokens")
    found = rows.groupBy("task").applyInArrow(lambda t: _join(t, percent), schema)
    return written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")


def open_keys(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Written members (token, _id, n, c, major) of the keys with two components or more; ``major`` is the first of them, which the
    smallest member has gathered."""
    named = keys.join(labels, "_id", "left").withColumn("c", F.coalesce("c", "_id"))
    ends = named.groupBy("token").agg(F.min("c").alias("major"), F.max("c").alias("_last")).where("major <> _last")
    return written(named.join(ends.drop("_last"), "token"), "open")


def star_pairs(members: DataFrame, first: bool, percent: int) -> DataFrame:
    """(a, na, ca, _id, n, c): one member of each key with the others: the smallest one, or the smallest outside the
    first component."""
    some = members if first else members.where("c <> major")
    chosen = some.groupBy("token").agg(F.min(F.struct("_id", "n", "c")).alias("m"))
    chosen = chosen.select("token", F.col("m._id").alias("a"), F.col("m.n").alias("na"), F.col("m.c").alias("ca"))
    fits = (F.col("c") != F.col("ca")) & (100 * F.least("n", "na") >= percent * F.greatest("n", "na"))
    return members.join(chosen, "token").where(fits).select("a", "na", "ca", "_id", "n", "c").distinct()


def _fitting(table: pa.Table, percent: int) -> pa.Table:
    """(a, na, ca, _id, n, c) of one task: pairs of a unit's probes and stored sets that sizes and parity bits allow."""
    table = table.combine_chunks().sort_by("unit")
    unit, n = table.column("unit").to_numpy(), table.column("n").to_numpy()
    probing = table.column("probe").to_numpy(zero_copy_only=False).astype(bool)
    _, group = np.unique(table.column("c").to_numpy(zero_copy_only=False), return_inverse=True)
    bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(unit), -1)
    cuts = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]])
    found = [np.zeros((2, 0), np.int64)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        stored = a + np.flatnonzero(~probing[a:b])
        for p in a + np.flatnonzero(probing[a:b]):
            other = stored[group[stored] != group[p]]
            both = n[other] + n[p]
            apart = np.bitwise_count(bits[other] ^ bits[p]).sum(axis=1, dtype=np.int64)
            other = other[(100 * np.minimum(n[other], n[p]) >= percent * np.maximum(n[other], n[p])) & (100 * (both - apart) >= percent * (both + apart))]
            found.append(np.stack([np.full(len(other), p), other]))
    sides = [table.take(pa.array(v)).select(["_id", "n", "c"]) for v in np.concatenate(found, axis=1)]
    return pa.table([*sides[0].columns, *sides[1].columns], ["a", "na", "ca", "_id", "n", "c"])


def last_pairs(members: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """(a, na, ca, _id, n, c): members of each key outside its first component with all of other components."""
    prints = members.groupBy("token").agg(
        F.bit_xor(F.xxhash64("_id", "c")).alias("x"), F.bit_xor(F.xxhash64("c", "_id")).alias("y"), F.count(F.lit(1)).alias("m"), F.first("major").alias("z")
    )
    one = prints.groupBy("x", "y", "m", "z").agg(F.min("token").alias("token")).select("token")
    rows = members.join(one, "token", "left_semi").withColumn("few", F.col("c") != F.col("major"))
    sizes = rows.groupBy("token").agg(*[(F.count_if(w) / _MEMBERS).cast("int").alias(k) for k, w in (("i", F.col("few")), ("j", F.lit(True)))])
    rows = rows.join(sizes, "token")
    own = {k: F.pmod(F.xxhash64("_id"), F.col(k) + 1).cast("int") for k in "ij"}
    every = {k: F.sequence(F.lit(0), F.col(k)) for k in "ij"}
    stored = rows.select("token", "_id", "n", "c", own["j"].alias("j"), F.explode(every["i"]).alias("i"), F.lit(False).alias("probe"))
    probes = rows.where("few").select("token", "_id", "n", "c", own["i"].alias("i"), F.explode(every["j"]).alias("j"), F.lit(True).alias("probe"))
    units = written(stored.unionByName(probes).select(F.xxhash64("token", "i", "j").alias("unit"), "probe", "_id", "n", "c"), "members")
    tasks = max(1, -(-units.count() // _ROWS))
    rows = units.join(facts, "_id").withColumn("task", F.pmod(F.xxhash64("unit"), F.lit(tasks)))
    kinds = {c: members.schema[c].dataType.simpleString() for c in ("_id", "n", "c")}
    schema = ", ".join(f"{name} {kinds[c]}" for name, c in zip(("a", "na", "ca", "_id", "n", "c"), ("_id", "n", "c") * 2))
    return rows.groupBy("task").applyInArrow(lambda t: _fitting(t, percent), schema).distinct()


def pair_units(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Units of the pairs that parity bits allow: a probe with sets that it meets, several units for a probe with many."""
    near = pairs.join(facts.select(F.col("_id").alias("a"), F.col("bits").alias("_l")), "a").join(facts.withColumnRenamed("bits", "_r"), "_id")
    apart = F.expr("aggregate(zip_with(_l, _r, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    both = F.col("na") + F.col("n")
    pairs = written(near.where(100 * (both - apart) >= percent * (both + apart)).select("a", "na", "ca", "_id", "n", "c"), "pairs")
    parts = pairs.groupBy("a").agg((F.sum("n") / _BLOCK).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("unit", F.xxhash64("a", F.pmod(F.xxhash64("_id"), F.col("parts") + 1)))
    stored = dealt.select("unit", F.lit(False).alias("probe"), "_id", "n", "c")
    probes = dealt.select("unit", F.lit(True).alias("probe"), F.col("a").alias("_id"), F.col("na").alias("n"), F.col("ca").alias("c")).distinct()
    return stored.unionByName(probes)


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable over links)."""
    made = sketches(docs, key=key, text=text, size=size, percent=percent)
    least = made.where("n > 0 and _id is not null").groupBy("n", "p1", "p2").agg(F.min("_id").alias("_id"))
    least = written(least, "least")
    keys = matchable(representatives(made, least), least.select("_id", "n"), percent)
    ids = written(keys.select("_id").distinct(), "ids")
    labels = ids.where("false").select("_id", F.col("_id").alias("c"))
    links = None
    if not ids.isEmpty():
        sets = full_sets(docs, ids, key=key, text=text, size=size)
        facts = sets.select("_id", "bits")
        for turn in range(_TURNS + 1):
            # before the first links every document is a component
            members = open_keys(keys, labels) if turn or turn == _TURNS else keys.withColumns({"c": F.col("_id"), "major": F.col("_id")})
            if members.isEmpty():
                break
            keys = members.select("token", "_id", "n")  # a key that is done stays so
            pairs = last_pairs(members, facts, percent) if turn == _TURNS else star_pairs(members, not turn, percent)
            found = joined(pair_units(pairs, facts, percent), sets, percent)
            links = found if links is None else links.unionByName(found)
            ends = links.select(F.col("a").alias("v")).union(links.select("b")).distinct()
            labels = written(components(ends, links, vertex="v", a="a", b="b").select(F.col("v").alias("_id"), F.col("component").alias("c")), "labels")
    top = least.join(labels, "_id", "left").select("n", "p1", "p2", F.coalesce("c", "_id").alias("c"))
    named = made.join(top, ["n", "p1", "p2"], "left").select("_id", "n", F.when(F.col("_id").isNotNull(), F.coalesce("c", "_id")).alias("c"))
    return named.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
