"""Spelling variants: words that differ in one code point, and the frequent form that each word leads to.

``vocabulary`` counts words over all documents. ``near`` finds all pairs of words at edit distance one with FM-indexes and
a search scheme; ``variants`` chooses forms and follows them.

Search scheme: one error leaves one half of a word as it is. So a word is matched from its end: the far half exactly, and
then on over the other half, where in each place one error (another code point, one more, one less) may be spent. This is
done twice, on an index of the words for errors in the first half and on an index of the mirrored words for errors in the
second half, which is the two-directional index of such schemes: a suffix-rank interval is always extended at the front.
The index of a shard is the text ``|word|word|...|`` by its suffix order; the delimiter anchors both ends of a match.

Shards: a word may only match words that share the exact half. Words are dealt by that half: as a query under its own
half, as text under every half that a query of its length or one less or more could have. A half with more than
``crowd`` words is split over shards, each of which gets all its queries. So a shard has a bounded part of the
vocabulary, no pair is lost and no pair is formed that is not found in an index.

Defined cases: null and empty texts have no words; a null id changes no word; repeated rows count again; an empty table
gives an empty result; only id and text are read. Words are compared by code points, without normalisation.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variascope.llm.io import written
from variascope.llm.words import lower, pack, ragged, slices, stretches, word_hashes

_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b == 0xC3 for b in range(256)])
_LONG = 64


def letters(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes of ``[A-Za-z\\u00C0-\\u00FF]``: in UTF-8, the latter are 0xC3 and one more byte."""
    mask = _LETTER[data]
    mask[1:] |= (data[:-1] == 0xC3) & (data[1:] & 0xC0 == 0x80)
    return mask


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range, continued from the checksums ``before``."""
    table, c = _crc_table(), before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    length = np.minimum(ends - starts, _LONG)
    live = np.arange(len(starts))
    for k in range(int(length.max(initial=0))):
        live = live[length[live] > k]
        c[live] = table[(c[live] ^ data[starts[live] + k]) & np.uint32(0xFF)] ^ (c[live] >> np.uint32(8))
    c ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(ends - starts > _LONG):
        c[k] = zlib.crc32(data[starts[k] + _LONG : ends[k]].tobytes(), int(c[k]))
    return c


def _counted(keys: pa.Array, texts: pa.Array, size: int, noise: int | None) -> tuple[pa.Array, pa.Array]:
    """(words, counts) of one batch: words of ``size`` code points or more."""
    data, offsets = pack(texts)
    data = lower(data)
    names = keys.cast(pa.string()).to_pylist() if noise else []
    found, changed = [], []
    for i, j in slices(offsets):
        base = offsets[i]
        part = data[base : offsets[j]]
        starts, ends, first = stretches(letters(part), offsets[i : j + 1] - base)
        more = np.concatenate([[0], np.cumsum(part & 0xC0 == 0x80)])
        points = ends - starts - (more[ends] - more[starts])
        wide = points >= size
        row = np.repeat(np.arange(i, j), np.diff(first))[wide]
        starts, ends, points = starts[wide], ends[wide], points[wide]
        if noise:
            known = np.array([name is not None for name in names[i:j]], bool)
            before = np.array([zlib.crc32(f"{name}:".encode()) for name in names[i:j]], np.uint32)
            h = checksums(part, starts, ends, before[row - i])
            hit = (h % np.uint32(noise) == 0) & known[row - i]
            for k in np.flatnonzero(hit & (points > size)):
                word, at = part[starts[k] : ends[k]].tobytes().decode(), int(h[k]) % int(points[k])
                changed.append(word[:at] + word[at + 1 :])
            starts, ends = starts[~hit], ends[~hit]
        found.append((word_hashes(part, starts, ends), starts + base, ends + base))
    if not found:
        return pa.array([], pa.string()), pa.array([], pa.int64())
    hashes, starts, ends = (np.concatenate(v) for v in zip(*found))
    _, at, many = np.unique(hashes, return_index=True, return_counts=True)
    lengths = ends[at] - starts[at]
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    distinct = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data[ragged(starts[at], lengths)])])
    words = pa.concat_arrays([distinct.cast(pa.string()), pa.array(changed, pa.string())])
    return words, pa.array(np.concatenate([many, np.ones(len(changed), np.int64)]))


def vocabulary(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 6, least: int = 5, noise: int | None = None
) -> DataFrame:
    """(word, n) of maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, with ``size`` code points and ``n >= least``.

    With ``noise``, a run whose CRC-32 h of ``<id>:<run>`` it divides loses its code point h % length first: planted errors. Words are
    counted per Arrow batch, then per task, then shuffled; a frequent word is a few rows.
    """

    def run(batches):
        for batch in batches:
            words, many = _counted(batch.column(0), batch.column(1), size, noise)
            yield pa.RecordBatch.from_arrays([words, many], ["word", "n"])

    rows = docs.select(F.col(key), F.col(text)).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Index:
    """FM-index of distinct words: intervals of suffixes of ``|w|w|...|`` that begin with what was matched so far."""

    def __init__(self, words: list[str]):
        self.n_words = len(words)
        points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.alphabet, text = np.unique(points, return_inverse=True)
        self.sigma, self.size = len(self.alphabet), len(text)
        text = text.astype(np.int64)
        suffixes = self._sorted(text)
        self.last = text[suffixes - 1]
        self.ranks = np.sort(self.last * self.size + np.arange(self.size))
        # the suffixes that begin with a delimiter, in order: which word follows
        self.word = np.searchsorted(np.flatnonzero(text == 0), suffixes[: self.n_words + 1])

    @staticmethod
    def _sorted(text: np.ndarray) -> np.ndarray:
        """Suffix order by doubling."""
        n, step, rank = len(text), 1, text
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1 if step < n else 0
            pair = rank * (n + 2) + ahead
            order = np.argsort(pair, kind="stable")
            new = np.ones(n, np.int64)
            new[1:] = pair[order[1:]] != pair[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            if new.all() or step >= n:
                return order
            step *= 2

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, offsets); code points that the index lacks get a code that matches nothing."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), self.sigma - 1)
        return np.where(self.alphabet[at] == points, at, self.sigma), np.concatenate([[0], np.cumsum([len(w) for w in words])])

    def extend(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more code point in front."""
        return np.searchsorted(self.ranks, code * self.size + low), np.searchsorted(self.ranks, code * self.size + high)

    def choices(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, code): the code points, but no delimiter, that stand in front of each interval's suffixes."""
        wide = high - low > 4 * self.sigma
        narrow = np.flatnonzero(~wide)
        width = (high - low)[narrow]
        seen = np.unique(np.repeat(narrow, width) * self.sigma + self.last[ragged(low[narrow], width)])
        every = np.repeat(np.flatnonzero(wide), self.sigma - 1) * self.sigma + np.tile(np.arange(1, self.sigma), int(wide.sum()))
        both = np.concatenate([seen[seen % self.sigma > 0], every])
        return both // self.sigma, both % self.sigma

    def one_error(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs at distance one whose last ``exact`` code points of the query are left as they are."""
        codes, offsets = self.codes(words)
        q = np.arange(len(words))
        left = np.diff(offsets)  # code points still to match, from the front
        low, high = np.zeros(len(q), np.int64), np.full(len(q), self.n_words + 1)
        rest = left - exact
        spent = []  # states after the error
        while len(q):
            free = np.flatnonzero(left <= rest[q])
            if len(free):
                # one code point less in the other word
                some = free[left[free] > 0]
                spent.append((q[some], left[some] - 1, low[some], high[some]))
                at, code = self.choices(low[free], high[free])
                at = free[at]
                a, b = self.extend(low[at], high[at], code)
                # one more, then another one
                spent.append((q[at], left[at], a, b))
                other = (left[at] > 0) & (codes[offsets[q[at]] + np.maximum(left[at], 1) - 1] != code)
                spent.append((q[at][other], left[at][other] - 1, a[other], b[other]))
            q, left, low, high = self._step(q, left, low, high, codes, offsets)
        q, left, low, high = (np.concatenate(v) for v in zip(*spent)) if spent else (np.zeros(0, np.int64),) * 4
        out = []
        while True:
            alive = low < high
            q, left, low, high = q[alive], left[alive], low[alive], high[alive]
            over = left == 0
            a, b = self.extend(low[over], high[over], np.zeros(int(over.sum()), np.int64))
            out.append((np.repeat(q[over], b - a), self.word[ragged(a, b - a)]))
            if over.all():
                break
            q, left, low, high = self._step(q, left, low, high, codes, offsets)
        q, word = (np.concatenate(v) for v in zip(*out))
        pairs = np.unique(q * np.int64(self.n_words + 1) + word)
        return pairs // (self.n_words + 1), pairs % (self.n_words + 1)

    def _step(self, q, left, low, high, codes, offsets):
        """The states that match one more code point of their query."""
        more = left > 0
        q, left, low, high = q[more], left[more] - 1, low[more], high[more]
        low, high = self.extend(low, high, codes[offsets[q] + left])
        alive = low < high
        return q[alive], left[alive], low[alive], high[alive]


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, near, near_n) of one shard with columns (mirrored, word, n, exact, query, stored)."""
    stored = rows[rows.stored].drop_duplicates("word")
    asked = rows[rows["query"]].drop_duplicates("word")
    if stored.empty or asked.empty:
        return pd.DataFrame({"word": [], "near": [], "near_n": []}).astype({"near_n": "int64"})
    turn = (lambda w: w[::-1]) if rows.mirrored.iloc[0] else (lambda w: w)
    index = Index([turn(w) for w in stored.word])
    q, w = index.one_error([turn(w) for w in asked.word], asked.exact.to_numpy(np.int64))
    return pd.DataFrame({"word": asked.word.to_numpy()[q], "near": stored.word.to_numpy()[w], "near_n": stored.n.to_numpy()[w]})


def halves(words: DataFrame) -> DataFrame:
    """(mirrored, half, exact, query, word, n): every half under which a word is stored; its own two are also queries."""
    half = "CASE WHEN mirrored THEN l div 2 ELSE l - l div 2 END"
    made = words.withColumn("length", F.length("word")).withColumn("l", F.explode(F.expr("sequence(length - 1, length + 1)")))
    made = made.withColumn("mirrored", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("exact", F.expr(half))
    made = made.withColumn("query", F.col("l") == F.col("length"))
    kept = made.groupBy("word", "n", "mirrored", "exact").agg(F.bool_or("query").alias("query"))
    return kept.withColumn("half", F.expr("CASE WHEN mirrored THEN left(word, exact) ELSE right(word, exact) END"))


def near(words: DataFrame, *, shard: int = 50_000, crowd: int = 20_000) -> DataFrame:
    """(word, near, near_n): all ordered pairs of the distinct ``words`` (word, n) that differ in one code point."""
    rows = written(halves(words), "halves")
    shards = max(1, -(-rows.count() // shard))
    crowded = rows.groupBy("mirrored", "half").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > crowd)
    split = rows.join(crowded, ["mirrored", "half"], "left").withColumn("parts", F.expr(f"coalesce(ceil(many / {crowd}), 1)").cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    asked = F.when(F.col("query"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    dealt = split.withColumn("own", own).withColumn("part", F.explode(asked)).withColumn("stored", F.col("part") == F.col("own"))
    place = F.pmod(F.xxhash64("half", "part"), F.lit(shards))
    dealt = dealt.withColumn("shard", place).select("mirrored", "shard", "word", "n", "exact", "query", "stored")
    return dealt.groupBy("mirrored", "shard").applyInPandas(_shard, "word string, near string, near_n long").distinct()


def variants(words: DataFrame, *, times: int = 5, **options) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each row of ``words`` (distinct word, n).

    ``form`` is the near word of largest n (the first in code-point order if equal) if that n is ``times`` * n or more, ``root`` the
    last word that forms lead to. Counts grow by ``times`` with each step, so few rounds of doubling reach it.
    """
    words = written(words.select("word", "n"), "words")
    best = near(words, **options).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("leads", F.expr(f"-best.m >= {times} * n"))
    made = written(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("leads"), F.col("best.near")).alias("form"),
            F.when(F.col("leads"), -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    links = made.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return made.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
