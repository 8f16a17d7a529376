"""Near-duplicate documents: MinHash with tensored banding, exact verification, connected components.

A document's set holds the hashes of its distinct shingles of ``size`` words (lower-cased; a shorter text is one
shingle). Documents with equal sets are one class and only the class's smallest id goes on, so copies cost nothing.

Tensored banding: two collections of ``pieces`` hashes each, a piece being two min-hashes. Table (i, j) is keyed by
piece i of the first and piece j of the second collection: 4 * pieces min-hashes serve pieces ** 2 tables of four
min-hashes each, where independent tables would need 4 * pieces ** 2. A pair of similarity s shares no key with
probability 1 - (1 - (1 - s ** 2) ** pieces) ** 2, 6e-6 at 0.85 with 10 pieces.

Pieces that one class has alone are dropped before the tables multiply them: they are in no shared key.
Keys are grouped with one map-side combined aggregation (count, smallest, largest member). Pairs of a key are never
all emitted. In the first round every member of a key meets the key's smallest member; pairs are verified on full
sets and linked ones are joined into components. A key whose members all lie in one component is then done. In later
rounds, members of the remaining keys meet further members (64 per key at first, eight times as many each round, so
all of them when a key is small) that lie in other components, until every key is done. A pair is left out only when it
was verified before, when both sides are already connected, or when it cannot be similar enough: shingles that occur
in no other document of the open keys are in no intersection, so the others bound it (``reachable``), and parity bits
of both sets bound it too (``allowed``). Edited copies that are too far from all the rest drop out there. So a group of n near copies costs about n
pairs, and no link that a shared key shows is lost.

Verification reads texts again: texts of documents in open pairs are found with a Bloom filter of their ids (bounded
broadcast), shuffled by id, and sets are compared exactly in Arrow batches.

Defined cases: null and empty texts and texts without words have an empty set and stay alone; every row gives one
row, so rows repeated with id and text share a component; ids are meant to be unique, and different texts under one
id count as linked through it, with one of them compared; rows with a null id have no component and link nothing; an
empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variascope.llm import bloom
from variascope.llm.io import written
from variascope.llm.words import NOT_SPACE, lists, lower, map_columns, mix, ngrams, pack, slices, word_hashes, words
from variascope.plans.components import components

_SMALL = 64
#: Bytes of text whose shingles are worked on at once.
_SLICE = 1 << 18
_BITS = [f"x{k}" for k in range(8)]


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): sorted distinct shingle hashes; row r has first[r]:first[r + 1]."""
    data = lower(data)
    starts, ends, first = words(data, offsets, NOT_SPACE)
    hashes = word_hashes(data, starts, ends)
    rows = len(offsets) - 1
    n = np.diff(first)
    many = np.maximum(n - size + 1, 0)
    grams = ngrams(hashes, size)
    at = np.repeat(first[:-1] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    value, owner = grams[at], np.repeat(np.arange(rows), many)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = n[short] > k
            whole[has] = mix(whole[has] + hashes[first[short[has]] + k] + np.uint64(k + 1))
        value, owner = np.concatenate([value, whole]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(rows + 1))


def signatures(values: np.ndarray, first: np.ndarray, pieces: int):
    """(pieces of both collections, rows x 2 * pieces) and two sums that identify the set."""
    rows = len(first) - 1
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((rows, 2 * pieces), np.int64)
    prints = np.zeros((rows, 2), np.int64)
    if len(some):
        at = first[some]
        for k in range(2 * pieces):
            pair = [np.minimum.reduceat(mix(values ^ np.uint64(0xD1B54A32D192ED03 * (2 * k + h + 1) % (1 << 64))), at) for h in (0, 1)]
            out[some, k] = mix(pair[0] + mix(pair[1])).view(np.int64)
        prints[some, 0] = np.add.reduceat(mix(values), at).view(np.int64)
        prints[some, 1] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at).view(np.int64)
    return out, prints


def bitmaps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """512 parity bits per row, as eight words: bit h of a set is the parity of its members that hash to h."""
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, len(_BITS)), np.int64)
    if len(some):
        place = values >> np.uint64(55)
        bit = np.uint64(1) << (place & np.uint64(63))
        for k in range(len(_BITS)):
            words_ = np.where(place >> np.uint64(6) == np.uint64(k), bit, np.uint64(0))
            out[some, k] = np.bitwise_xor.reduceat(words_, first[some]).view(np.int64)
    return out


def sketches(docs: DataFrame, *, key: str, text: str, size: int, pieces: int) -> DataFrame:
    """Written table (_id, n, p1, p2, sig, x0 .. x7) of all rows."""
    added = T.StructType(
        [
            T.StructField("n", T.LongType()),
            T.StructField("p1", T.LongType()),
            T.StructField("p2", T.LongType()),
            T.StructField("sig", T.ArrayType(T.LongType())),
            *[T.StructField(x, T.LongType()) for x in _BITS],
        ]
    )

    def make(column):
        data, offsets = pack(column)
        parts = []
        for i, j in slices(offsets, _SLICE):
            values, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            parts.append((np.diff(first), *signatures(values, first, pieces), bitmaps(values, first)))
        if not parts:
            return [pa.array([], kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * len(_BITS))]
        n, sig, prints, bits = (np.concatenate([p[k] for p in parts]) for k in range(4))
        columns = [n.astype(np.int64), *prints.T, *bits.T]
        n, p1, p2, *bits = (pa.array(np.ascontiguousarray(c)) for c in columns)
        return [n, p1, p2, lists(pa.array(sig.ravel()), np.full(len(n), 2 * pieces)), *bits]

    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    return written(map_columns(rows, "_text", make, added, ["_id"]), "sketches")


def keyed(classes: DataFrame, pieces: int) -> DataFrame:
    """(key, _id, n): the keys of all classes that another class may have too. A key needs both of its pieces there, so pieces of
    one class only are left out before the tables multiply them."""
    rows = classes.select("_id", "n", F.posexplode("sig").alias("k", "u")).select("_id", "n", (F.col("k") < pieces).alias("early"), F.xxhash64("k", "u").alias("piece"))
    again = rows.groupBy("piece").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("piece")
    sides = [F.collect_list(F.when(side, F.col("piece"))).alias(name) for name, side in (("u", F.col("early")), ("v", ~F.col("early")))]  # 2 * pieces a class
    held = rows.join(again, "piece", "left_semi").groupBy("_id", "n").agg(*sides).where("size(u) > 0 and size(v) > 0")
    return written(held, "pieces").select("_id", "n", F.explode("u").alias("u"), "v").select("_id", "n", "u", F.explode("v").alias("w")).select(F.xxhash64("u", "w").alias("key"), "_id", "n")


def candidates(classes: DataFrame, pieces: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of every key's members with its smallest one, and the rows of keys with three or more."""
    keys = keyed(classes, pieces)
    # plain minima and maxima of ids are hash aggregates; set sizes of the few ids that remain are looked up
    ends = [F.min("_id").alias("low"), F.max("_id").alias("high"), F.count(F.lit(1)).alias("many")]
    groups = written(keys.groupBy("key").agg(*ends).where("many > 1"), "groups")
    sizes = classes.select("_id", "n")
    low, high = (sizes.withColumnsRenamed({"_id": end, "n": n}) for end, n in (("low", "na"), ("high", "nb")))
    two = groups.where("many = 2").select("low", "high").distinct().join(low, "low").join(high, "high")
    two = two.select(F.col("low").alias("a"), F.col("high").alias("b"), "na", "nb")
    crowded = groups.where("many > 2").select("key", "low")
    bits = bloom.bits_for(crowded.count())
    near = bloom.flag(keys, "key", bloom.present(crowded, "key", bits), bits, "_maybe").where("_maybe").drop("_maybe")
    members = written(near.join(crowded.join(low, "low").select("key", F.col("low").alias("a"), "na"), "key"), "members")
    star = members.where("a <> _id").select("a", F.col("_id").alias("b"), "na", F.col("n").alias("nb"))
    return two.unionByName(star).distinct(), members.select("key", "_id", "n")


def paired(pairs: DataFrame, docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """(a, b, ta, tb): the pairs with both texts. Only texts of ids in ``pairs`` (by Bloom filter) are shuffled."""
    ids = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
    bits = bloom.bits_for(ids.count())
    texts = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = bloom.flag(texts, "_id", bloom.present(ids, "_id", bits), bits, "_maybe").where("_maybe").select("_id", "_text")
    texts = texts.join(ids, "_id", "left_semi").dropDuplicates(["_id"])
    both = pairs.join(texts.withColumnsRenamed({"_id": "a", "_text": "ta"}), "a").join(texts.withColumnsRenamed({"_id": "b", "_text": "tb"}), "b")
    return both.select("a", "b", "ta", "tb")


def verified(pairs: DataFrame, docs: DataFrame, *, key: str, text: str, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches):
        for batch in batches:
            left, right = (pack(batch.column(k)) for k in (2, 3))
            good = np.zeros(batch.num_rows, bool)
            sizes = np.append(0, np.cumsum(np.diff(left[1]) + np.diff(right[1])))
            for i, j in slices(sizes, _SLICE):
                sets = [shingles(d[o[i] : o[j]], o[i : j + 1] - o[i], size) for d, o in (left, right)]
                for r in range(j - i):
                    x, y = (v[f[r] : f[r + 1]] for v, f in sets)
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    good[i + r] = 100 * common >= percent * (len(x) + len(y) - common) > 0
            yield batch.select([0, 1]).filter(pa.array(good))

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return paired(pairs, docs, key=key, text=text).mapInArrow(run, schema)


def allowed(a: str, b: str, percent: int):
    """Whether set sizes ``n`` and parity bits of two sides allow the similarity: bits that differ are as many
    members of one set only, at least."""
    apart = sum((F.bit_count(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))) for x in _BITS), F.lit(0))
    both = F.col(f"{a}n") + F.col(f"{b}n")
    # intersection <= (both - apart) / 2 and union = both - intersection
    return 100 * (both - apart) >= percent * (both + apart)


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets may have the similarity."""
    near = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    facts = sets.select("_id", "n", *_BITS)
    for side in ("a", "b"):
        near = near.join(facts.withColumnsRenamed({"_id": side, "n": f"{side}n", **{x: f"{side}{x}" for x in _BITS}}), side)
    return near.where(allowed("a", "b", percent)).select("a", "b")


def recurring(docs: DataFrame, ids: DataFrame, *, key: str, text: str, size: int) -> DataFrame:
    """(_id, v): how many shingles of each document in ``ids`` occur in another of them, never too few; documents with
    none have no row.

    Texts stay where they are read, shingle hashes are shuffled: a filter of them would be broadcast at its largest size.
    """
    bits = bloom.bits_for(ids.count())
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where(F.col(key).isNotNull())
    near = bloom.flag(rows, "_id", bloom.present(ids, "_id", bits), bits, "_maybe").where("_maybe").select("_id", "_text")

    def run(batches):
        for batch in batches:
            data, offsets = pack(batch.column(1))
            for i, j in slices(offsets, _SLICE):
                values, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                owner = np.repeat(np.arange(i, j), np.diff(first))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(values.view(np.int64))], ["_id", "h"])

    schema = T.StructType([T.StructField("_id", docs.schema[key].dataType), T.StructField("h", T.LongType())])
    grams = written(near.mapInArrow(run, schema), "grams")
    again = grams.groupBy("h").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("h")
    return grams.join(again, "h", "left_semi").groupBy("_id").agg(F.count(F.lit(1)).alias("v"))


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their component ``c``, of the keys that hold two components or more, and counts of those keys."""
    named = members.join(labels, "_id", "left").withColumn("c", F.coalesce("c", "_id"))
    facts = [F.count(F.lit(1)).alias("many"), F.min("n").alias("n0")]
    split = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), *facts).where("c0 <> c1").drop("c0", "c1")
    return written(named.join(split, "key"), "open")


def reachable(na: str, va: str, nb: str, vb: str, percent: int):
    """Whether sets of these sizes and numbers of recurring shingles may have the similarity."""
    common = F.least(va, vb, na, nb)
    return 100 * common >= percent * (F.col(na) + F.col(nb) - common)


def further(rows: DataFrame, turn: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of a later round: pairs across components with chosen members of each open key.

    A member that no member of its key can match, by set sizes and recurring shingles, is done with that key: the best
    match has as many shingles as may recur, or is the smallest member if that has more.
    """
    rest = rows.where(100 * F.col("v") >= percent * (F.col("n") + F.greatest("n0", "v") - F.col("v")))
    columns = ["_id", "n", "v", "c", *_BITS]
    rest = written(rest.withColumn("rank", F.pmod(F.xxhash64("key", "_id"), F.lit(1 << 30)) / float(1 << 30)), "rest")
    quota = F.when(F.col("many") <= _SMALL, F.col("many")).otherwise(F.lit(_SMALL * 8**turn))
    # a member is chosen when its rank lies among the quota smallest on average; every member when the key is small
    chosen = F.col("rank") * F.col("many") < quota
    left, right = (part.select("key", *[F.col(c).alias(f"{side}{c}") for c in columns]) for side, part in (("l", rest.where(chosen)), ("r", rest)))
    fits = (F.col("lc") != F.col("rc")) & reachable("ln", "lv", "rn", "rv", percent) & allowed("l", "r", percent)
    pairs = left.join(right, "key").where(fits).select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"))
    # chosen members have met all others of the key across components, the rest of the key stays open
    return pairs.distinct(), rest.where(~chosen).drop("c", "many", "n0", "rank")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(_id, c) of all linked ids after further links: only the components that the links touch are worked on."""
    known = written(
        links.select(F.col("a").alias("_id")).union(links.select("b")).distinct().join(labels, "_id", "left").select("_id", F.coalesce("c", "_id").alias("c")),
        "known",
    )
    left, right = (known.withColumnsRenamed({"_id": side, "c": f"c{side}"}) for side in ("a", "b"))
    edges = written(links.join(left, "a").join(right, "b").where("ca <> cb").select("ca", "cb").distinct(), "edges")
    ends = edges.select(F.col("ca").alias("v")).union(edges.select("cb")).distinct()
    moved = components(ends, edges, vertex="v", a="ca", b="cb").select(F.col("v").alias("c"), "component")
    every = labels.unionByName(known.join(labels, "_id", "left_anti"))
    return written(every.join(moved, "c", "left").select("_id", F.coalesce("component", "c").alias("c")), "labels")


def classes(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85, pieces: int = 10
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable over links)."""
    made = sketches(docs, key=key, text=text, size=size, pieces=pieces)
    same = (
        made.where("n > 0 and _id is not null")
        .groupBy("n", "p1", "p2")
        .agg(F.min(F.struct("_id", "sig", *_BITS)).alias("m"))
        .select("n", "p1", "p2", "m.*")
    )
    same = written(same, "classes")
    pairs, members = candidates(same, pieces)
    option = {"key": key, "text": text, "size": size}
    pairs = written(plausible(pairs, same, percent), "pairs")
    labels = same.where("false").select("_id", F.col("_id").alias("c"))
    tried, turn = pairs, 0
    while True:
        if not pairs.isEmpty():
            links = written(verified(pairs, docs, percent=percent, **option), "links")
            labels = labels if links.isEmpty() else relabelled(labels, links)
        rows = open_members(members, labels)
        if rows.isEmpty():
            break
        if turn == 0:
            facts = written(recurring(docs, rows.select("_id").distinct(), **option), "recurring").join(same.select("_id", *_BITS), "_id")
            rows = written(rows.join(facts, "_id"), "open")
        fresh, members = further(rows, turn, percent)
        pairs = written(fresh.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        turn += 1
    top = same.join(labels, "_id", "left").select("n", "p1", "p2", F.coalesce("c", "_id").alias("c"))
    named = made.join(top, ["n", "p1", "p2"], "left").select("_id", "n", F.when(F.col("_id").isNotNull(), F.coalesce("c", "_id")).alias("c"))
    return named.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component (the smallest id), with its own columns; rows with a null id stay."""
    found = classes(docs, key=key, text=text, **options)
    gone = written(found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone")).distinct(), "gone")
    bits = bloom.bits_for(gone.count())
    flagged = bloom.flag(docs.withColumn("_gone", F.col(key)), "_gone", bloom.present(gone, "_gone", bits), bits, "_maybe")
    columns = [f"`{c}`" for c in docs.columns]
    # only documents that may go are shuffled
    return flagged.where(~F.col("_maybe")).select(*columns).unionByName(flagged.where("_maybe").join(gone, "_gone", "left_anti").select(*columns))
