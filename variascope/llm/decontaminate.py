"""Benchmark decontamination by Wu-Manber search over words.

Every window of ``window`` consecutive item words is a pattern (a shorter item is one pattern of its own length).
Patterns of one length m share three tables: a shift table over blocks of B words (how far the search window may
move because no pattern holds that block nearer to its end), buckets by the hash of the last block, and the
patterns themselves. Documents are searched in lanes: all lanes of an Arrow slice move together, each by its own
shift, and where the shift is 0 the bucket's patterns are compared word by word and then byte by byte.

Items are the small side: their tables are broadcast. Items of more than ``max_item_bytes`` are split into blocks
by hash and the documents pass through one map per block, so what is broadcast stays bounded; nothing shuffles.

Defined cases: a null or empty text has no words and is never hit; a null or empty item has no pattern; an item with
a null id marks words as hit but is not counted; repeated items count once per id; an empty table gives no hits.
Columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variascope.llm.words import ALNUM, SLICE, lists, lower, map_columns, ngrams, pack, ragged, slices, word_hashes, words

LANE = 256
_BUCKET_ROWS = 1 << 16

ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
        T.StructField(
            "hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
        ),
    ]
)


class Patterns:
    """Shift, bucket and pattern tables of all patterns with ``size`` words."""

    def __init__(self, size: int, found: dict[bytes, set[int]]):
        self.size, self.block = size, min(3, size)
        self.texts = sorted(found)
        self.items = [sorted(found[t]) for t in self.texts]
        flat = [w for t in self.texts for w in t.split(b" ")]
        ends = np.cumsum([len(w) for w in flat])
        data = np.frombuffer(b"".join(flat), np.uint8)
        hashes = word_hashes(data, ends - np.array([len(w) for w in flat]), ends)
        self.hashes = hashes.reshape(len(self.texts), size)
        blocks = [ngrams(self.hashes[:, t : t + self.block].ravel(), self.block)[:: self.block] for t in range(size - self.block + 1)]
        self.bits = min(26, max(12, int(np.ceil(np.log2(64 * len(self.texts) * len(blocks))))))
        self.shift = np.full(1 << self.bits, size - self.block + 1, np.int64)
        for t, block in enumerate(blocks):
            np.minimum.at(self.shift, self.slot(block), size - self.block - t)
        order = np.argsort(blocks[-1], kind="stable")
        self.suffix, self.order = blocks[-1][order], order

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word positions, pattern numbers) where all word hashes of a pattern agree."""
        none = np.zeros(0, np.int64)
        starts = np.maximum(np.diff(first) - self.size + 1, 0)
        if not starts.sum():
            return none, none
        blocks = ngrams(hashes, self.block)
        move = self.shift[self.slot(blocks)]
        lanes = -(-starts // LANE)
        number = ragged(np.zeros(len(lanes), np.int64), lanes)
        at = np.repeat(first[:-1], lanes) + number * LANE
        stop = np.minimum(at + LANE, np.repeat(first[:-1] + starts, lanes))
        behind = self.size - self.block
        places = []
        while at.size:
            step = move[at + behind]
            if (hit := step == 0).any():
                places.append(at[hit])
            at = at + np.maximum(step, 1)
            if not (open_ := at < stop).all():
                at, stop = at[open_], stop[open_]
        if not places:
            return none, none
        places = np.sort(np.concatenate(places))
        low = np.searchsorted(self.suffix, blocks[places + behind], side="left")
        many = np.searchsorted(self.suffix, blocks[places + behind], side="right") - low
        out_p, out_k = [], []
        a = 0
        sums = np.cumsum(many)
        while a < len(places):
            b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + _BUCKET_ROWS, side="right")))
            p = np.repeat(places[a:b], many[a:b])
            k = self.order[ragged(low[a:b], many[a:b])]
            same = (hashes[p[:, None] + np.arange(self.size)] == self.hashes[k]).all(axis=1)
            out_p.append(p[same])
            out_k.append(k[same])
            a = b
        return np.concatenate(out_p), np.concatenate(out_k)


def item_words(text: str | None) -> list[bytes]:
    data, offsets = pack(pa.array([text], pa.string()))
    data = lower(data)
    starts, ends, _ = words(data, offsets, ALNUM)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends)]


def build(items: list[tuple[str | None, str | None]], window: int) -> tuple[list[str | None], list[Patterns]]:
    ids = sorted({i for i, _ in items if i is not None}) + [None]
    number = {name: k for k, name in enumerate(ids)}
    by_size: dict[int, dict[bytes, set[int]]] = {}
    for name, text in items:
        tokens = item_words(text)
        if not tokens:
            continue
        size = min(window, len(tokens))
        found = by_size.setdefault(size, {})
        for k in range(len(tokens) - size + 1):
            found.setdefault(b" ".join(tokens[k : k + size]), set()).add(number[name])
    return ids, [Patterns(size, found) for size, found in sorted(by_size.items())]


def scan_slice(data, offsets, ids, tables):
    """Per row: words, hit words, item ids, spans of hit words (first, last) as flat arrays with lengths."""
    data = lower(data)
    starts, ends, first = words(data, offsets, ALNUM)
    rows = len(offsets) - 1
    hashes = word_hashes(data, starts, ends)
    edge = np.zeros(len(starts) + 1, np.int64)
    found: set[tuple[int, int]] = set()
    for table in tables:
        p, k = table.search(hashes, first)
        row = np.searchsorted(first, p, side="right") - 1
        for at, which, r in zip(p.tolist(), k.tolist(), row.tolist()):
            spelled = b" ".join(data[starts[w] : ends[w]].tobytes() for w in range(at, at + table.size))
            if spelled == table.texts[which]:
                edge[at] += 1
                edge[at + table.size] -= 1
                found.update((r, i) for i in table.items[which])
    hit = np.cumsum(edge[:-1]) > 0
    until = np.concatenate([[0], np.cumsum(hit)])
    n_hit = until[first[1:]] - until[first[:-1]]
    opening = hit.copy()
    opening[1:] &= ~hit[:-1]
    heads = first[:-1][first[:-1] < len(hit)]
    opening[heads] = hit[heads]
    closing = hit.copy()
    closing[:-1] &= ~hit[1:]
    tails = first[1:][first[1:] > 0] - 1
    closing[tails] = hit[tails]
    begin, end = np.flatnonzero(opening), np.flatnonzero(closing)
    owner = np.searchsorted(first, begin, side="right") - 1
    names: list[list[str]] = [[] for _ in range(rows)]
    for r, i in sorted(found):
        if ids[i] is not None:
            names[r].append(ids[i])
    return (
        np.diff(first),
        n_hit,
        [sorted(set(x)) for x in names],
        np.bincount(owner, minlength=rows),
        begin - first[owner],
        end - first[owner],
    )


def scanner(shared):
    """Function of a text column for ``map_columns``; ``shared`` is the broadcast (ids, tables)."""
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def make(column):
        data, offsets = pack(column)
        parts = [scan_slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], *shared.value) for i, j in slices(offsets, SLICE)]
        if not parts:
            return [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(span))]
        n_words, n_hit, _, many, begin, end = (np.concatenate(x) if k != 2 else x for k, x in enumerate(zip(*parts)))
        names = [x for part in parts for x in part[2]]
        pairs = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], fields=list(span))
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), lists(pairs, many)]

    return make


def item_blocks(benchmark: DataFrame, item: str, text: str, max_item_bytes: int):
    """Lists of (id as text, text), each of about ``max_item_bytes`` at most (a longer single item stands alone)."""
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // max_item_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    max_item_bytes: int = 32 << 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` plus n_words, n_hit, hit_items (sorted ids as text) and hit_spans (word ranges, last included)."""
    context = docs.sparkSession.sparkContext
    out, kept = None, list(docs.columns) if keep is None else list(keep)
    names = [f.name for f in ADDED]
    for block in item_blocks(benchmark, item, item_text, max_item_bytes):
        make = scanner(context.broadcast(build(block, window)))
        if out is None:
            out = map_columns(docs, text, make, ADDED, list(dict.fromkeys([*kept, text])))
        else:
            before = out.withColumnsRenamed({n: f"_{n}" for n in names})
            out = map_columns(before, text, make, ADDED).select(
                *[c for c in out.columns if c not in names],
                "n_words",
                F.array_sort(F.array_distinct(F.concat("_hit_items", "hit_items"))).alias("hit_items"),
                merged("_hit_spans", "hit_spans").alias("hit_spans"),
            )
            out = out.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1))
            out = out.select(*[c for c in out.columns if c not in names], *names)
    return out.select(*[f"`{c}`" for c in kept if c not in names], *names)


def merged(left: str, right: str):
    """Union of two lists of word ranges as maximal ranges."""
    start = F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")

    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))
        return F.when((F.size(done) > 0) & (s["first"] <= last["last"] + 1), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(s))
        )

    return F.aggregate(F.array_sort(F.concat(left, right)), start, add)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without any hit word, with their own columns."""
    text = options.get("text", "text")
    ids = [build(b, options.get("window", 10)) for b in item_blocks(benchmark, options.get("item", "item_id"), options.get("item_text", "text"), options.get("max_item_bytes", 32 << 20))]
    shared = [docs.sparkSession.sparkContext.broadcast(t) for t in ids]
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            free = np.ones(batch.num_rows, bool)
            data, offsets = pack(batch.column(at))
            for names in shared:
                for i, j in slices(offsets, SLICE):
                    free[i:j] &= scan_slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], *names.value)[1] == 0
            yield batch.filter(pa.array(free))

    return docs.mapInArrow(run, docs.schema)
