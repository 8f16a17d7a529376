"""Runs of repeated words in texts: grammar-compressed run detection.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least ``least`` words and
at least 2 * q, that no neighbouring word extends. Per document:

1. Re-Pair on word ids: the most frequent pair of neighbouring symbols becomes a nonterminal, until no pair recurs.
   All documents of a slice go in step, and in one round every pair that outnumbers all pairs it overlaps is replaced.
   Re-Pair would replace such a pair with the same occurrences when its turn comes, so the grammar is that of one pair
   at a time (equal counts in a fixed order).
2. Runs that cross the boundary of a nonterminal are computed once, at its first place. What Re-Pair leaves of the
   document is closed by a balanced binary tree, whose nodes are nonterminals used once. A run of q + 6 words or more that
   crosses a boundary shows the three words before or behind it once more at distance q, so only such places are
   extended, by doubling fingerprints of 2 ** k words.
3. A nonterminal's runs are translated to all places where it was put, and merged: a piece that lies in a longer run of
   the same period goes, and of equal stretches the smallest period stays.

Every run lies in some nonterminal whose boundary it crosses, so none is lost. Documents in which no six words recur have
no run (a run of ``least`` >= 12 words or 2 * q repeats six words at distance q) and get no grammar.

Documents are independent: a map over Arrow batches without a shuffle, slices of about 1 MB of text, a longer text alone.
Memory is 8 bytes * words of a slice * log2 of the longest repeat.

Defined cases: null and empty texts and texts of spaces have no words, no runs and an empty collapsed text; repeated rows
give repeated rows; an empty table gives an empty result; columns of the table stay, one named like an added column is
replaced by it. Word ids are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from variascope.llm.words import NOT_SPACE, lists, map_columns, mix, ngrams, pack, ragged, slices, word_hashes, words

_SHARED = 6  # equal words at distance q in any run of 12 words or more
_EDGE = 3  # of which three lie on one side of a boundary
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.int64(1) << np.int64(40)

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def recurring(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows in which some ``_SHARED`` consecutive words occur twice."""
    n = np.diff(first)
    many = np.maximum(n - _SHARED + 1, 0)
    owner = np.repeat(np.arange(len(n)), many)
    grams = ngrams(ids, _SHARED)[ragged(first[:-1], many)]
    grams = mix(grams ^ (owner.astype(np.uint64) * _STEP))
    order = np.argsort(grams)
    again = order[1:][grams[order[1:]] == grams[order[:-1]]]
    return np.unique(owner[again])


def repair(symbols: np.ndarray, owner: np.ndarray):
    """Re-Pair of many documents at once.

    ``symbols`` are non-negative ids that no two documents share, ``owner`` the document of each. Returns the symbols that are left,
    as (place, owner), and the rules, as (a, m, b) of the first place, (first, places) of all places where each was put.
    """
    place = np.arange(len(symbols))
    size = np.ones(len(symbols), np.int64)
    fresh = int(symbols.max(initial=-1)) + 1
    done, rules, puts, counts = [], [], [], []
    while len(symbols):
        joined = owner[1:] == owner[:-1]
        at = np.flatnonzero(joined)
        left, right = symbols[at], symbols[at + 1]
        # of a stretch of one symbol, every other pair counts
        same = left == right
        head = np.ones(len(at), bool)
        head[1:] = ~(same[1:] & same[:-1] & (at[1:] == at[:-1] + 1) & (left[1:] == left[:-1]))
        offset = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        real = ~same | (offset % 2 == 0)
        _, kind = np.unique(left * np.int64(fresh) + right, return_inverse=True)
        many = np.bincount(kind[real], minlength=int(kind.max(initial=-1)) + 1)
        rank = np.empty(len(many), np.int64)
        rank[np.lexsort((np.arange(len(many)), many))] = np.arange(len(many))
        near = np.flatnonzero(at[1:] == at[:-1] + 1)
        x, y = kind[near], kind[near + 1]
        rival = x != y
        x, y = x[rival], y[rival]
        chosen = many > 1
        chosen[np.where(rank[x] < rank[y], x, y)] = False
        hit = real & chosen[kind]
        # documents without a recurring pair are done
        busy = np.zeros(int(owner.max(initial=-1)) + 1, bool)
        busy[owner[at[many[kind] > 1]]] = True
        rest = ~busy[owner]
        done.append((place[rest], owner[rest]))
        if hit.any():
            number = np.cumsum(chosen) - 1
            put, new = at[hit], number[kind[hit]]
            order = np.argsort(new, kind="stable")
            put, new = put[order], new[order]
            opening = np.flatnonzero(np.append(True, new[1:] != new[:-1]))
            p = put[opening]
            rules.append(np.stack([place[p], place[p] + size[p], place[p] + size[p] + size[p + 1]]))
            puts.append(place[put])
            counts.append(np.diff(np.append(opening, len(put))))
            symbols[put] = fresh + new
            size[put] += size[put + 1]
            fresh += len(opening)
            rest[put + 1] = True
        keep = ~rest
        symbols, owner, place, size = symbols[keep], owner[keep], place[keep], size[keep]
    place, owner = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
    order = np.argsort(place)
    a, m, b = np.concatenate(rules, axis=1) if rules else np.zeros((3, 0), np.int64)
    sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (place[order], owner[order]), (a, m, b), (sizes, np.concatenate(puts) if puts else np.zeros(0, np.int64))


def tree_nodes(place: np.ndarray, owner: np.ndarray, ends: np.ndarray):
    """(a, m, b) of a balanced binary tree over each document's remaining symbols; ``ends`` are the documents' ends.

    The boundary before symbol t of a document, t = odd * 2 ** z, belongs to a node over symbols t - 2 ** z to t + 2 ** z.
    """
    opening = np.ones(len(place), bool)
    opening[1:] = owner[1:] != owner[:-1]
    head = np.maximum.accumulate(np.where(opening, np.arange(len(place)), 0))
    last = np.append(np.flatnonzero(opening)[1:], len(place))
    tail = np.repeat(last, np.diff(np.append(np.flatnonzero(opening), len(place))))
    at = np.flatnonzero(~opening)
    t = at - head[at]
    reach = t & -t
    high = np.minimum(at + reach, tail[at])
    beyond = high == tail[at]
    b = np.where(beyond, ends[owner[at]], place[np.minimum(high, len(place) - 1)])
    return place[at - reach], place[at], b


class Repeats:
    """Longest equal stretches of a sequence, by fingerprints of 2 ** k words made when first needed."""

    def __init__(self, ids: np.ndarray):
        self.levels = [mix(ids)]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            joined = last.copy()
            joined[: len(last) - half] = mix(last[: len(last) - half] * _STEP + last[half:])
            self.levels.append(joined)
        return self.levels[k]

    def common(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray, forward: bool) -> np.ndarray:
        """Number of equal words from x and y on (or before them), at most ``limit``."""
        out = np.zeros(len(x), np.int64)
        stuck = np.zeros(len(x), np.int64)

        def step(live: np.ndarray, k: int) -> np.ndarray:
            fits = live[out[live] + (1 << k) <= limit[live]]
            shift = out[fits] if forward else -out[fits] - (1 << k)
            names = self.level(k) if len(fits) else None
            good = fits[names[x[fits] + shift] == names[y[fits] + shift]] if len(fits) else fits
            out[good] += 1 << k
            return good

        live, k = np.arange(len(x)), 0
        while len(live):
            live = step(live, k)
            k += 1
            stuck[live] = k
        for k in range(k - 1, -1, -1):
            step(np.flatnonzero(stuck >= k), k)
        return out


def crossing(a: np.ndarray, m: np.ndarray, b: np.ndarray, ids: np.ndarray, least: int):
    """(node, start, end, period) of the runs inside [a, b) that a place with equal words near the boundary m shows."""
    known = Repeats(ids)
    n = len(ids)
    if n < _EDGE or not len(a):
        return (np.zeros(0, np.int64),) * 4
    _, gram = np.unique(ngrams(ids, _EDGE), return_inverse=True)
    order = np.argsort(gram, kind="stable")
    at = gram[order].astype(np.int64) * n + order
    found = []
    for shift in (0, _EDGE):  # the three words behind the boundary, then those before it
        own = np.flatnonzero((m - shift >= a) & (m - shift + _EDGE <= b))
        g = gram[m[own] - shift].astype(np.int64) * n
        low, high = np.searchsorted(at, g + a[own]), np.searchsorted(at, g + b[own] - _EDGE, side="right")
        other = order[ragged(low, high - low)] + shift
        node = np.repeat(own, high - low)
        found.append((node[other != m[node]], other[other != m[node]]))
    node, other = (np.concatenate(parts) for parts in zip(*found))
    x, y = np.minimum(other, m[node]), np.maximum(other, m[node])
    q = y - x
    ahead = known.common(x, y, b[node] - y, True)
    behind = known.common(x, y, x - a[node], False)
    length = q + ahead + behind
    good = length >= np.maximum(least, 2 * q)
    node, start, end, q = node[good], (x - behind)[good], (y + ahead)[good], q[good]
    order = np.lexsort((q, end, start, node))
    node, start, end, q = node[order], start[order], end[order], q[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[new], start[new], end[new], q[new]


def merged(start: np.ndarray, end: np.ndarray, q: np.ndarray):
    """(start, end, period) in order: pieces inside a longer stretch of their period go, then larger periods of equal stretches."""
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    reach = q * _FAR + end
    longer = np.ones(len(q), bool)
    longer[1:] = np.maximum.accumulate(reach)[:-1] < reach[1:]
    start, end, q = start[longer], end[longer], q[longer]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(q), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    order = np.lexsort((q[new], start[new]))
    return tuple(v[new][order] for v in (start, end, q))


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = 12):
    """(row, start, length, period) of all runs, by row, start, period; row r has the word ids first[r]:first[r + 1]."""
    rows = recurring(ids, first)
    if not len(rows):
        return (np.zeros(0, np.int64),) * 4
    n = np.diff(first)[rows]
    words_of = ids[ragged(first[rows], n)]
    heads = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(rows)), n)
    _, symbols = np.unique(mix(words_of ^ mix(owner.astype(np.uint64) + _STEP)), return_inverse=True)
    left, (a, m, b), (sizes, puts) = repair(symbols.astype(np.int64), owner)
    ta, tm, tb = tree_nodes(*left, heads + n)
    opening = np.concatenate([np.cumsum(sizes) - sizes, np.zeros(len(ta), np.int64)])
    sizes = np.concatenate([sizes, np.zeros(len(ta), np.int64)])
    a, m, b = np.concatenate([a, ta]), np.concatenate([m, tm]), np.concatenate([b, tb])
    wide = np.flatnonzero(b - a >= least)
    node, start, end, q = crossing(a[wide], m[wide], b[wide], words_of, least)
    node = wide[node]
    # a rule's runs at all its places; a tree node has one place
    rule = sizes[node] > 0
    times = np.where(rule, sizes[node], 1)
    shift = np.zeros(int(times.sum()), np.int64)
    many = np.repeat(rule, times)
    which = np.repeat(np.arange(len(node)), times)
    shift[many] = puts[ragged(opening[node[rule]], sizes[node[rule]])] - a[node[which[many]]]
    start, end, q = merged(start[which] + shift, end[which] + shift, q[which])
    doc = np.searchsorted(heads, start, side="right") - 1
    return rows[doc], start - heads[doc], end - start, q


def _found(column: pa.Array, least: int) -> list[pa.Array]:
    data, offsets = pack(column)
    many, parts, texts = np.zeros(len(column), np.int64), [], []
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = words(part, offsets[i : j + 1] - offsets[i], NOT_SPACE)
        row, start, length, q = runs_of(word_hashes(part, starts, ends), first, least)
        many[i:j] = np.bincount(row, minlength=j - i)
        parts.append(np.stack([start, length, q]))
        at = np.concatenate([[0], np.cumsum(many[i:j])])
        raw, bounds = part.tobytes(), offsets[i : j + 1] - offsets[i]
        for r in range(j - i):
            kept = raw[bounds[r] : bounds[r + 1]].split()
            if many[i + r]:
                gone = np.zeros(len(kept) + 1, np.int64)
                k = slice(at[r], at[r + 1])
                np.add.at(gone, start[k] + q[k], 1)
                np.add.at(gone, start[k] + length[k], -1)
                kept = [kept[w] for w in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
            texts.append(b" ".join(kept))
    values = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
    fields = [pa.array(np.ascontiguousarray(v)) for v in values]
    return [lists(pa.StructArray.from_arrays(fields, [f.name for f in RUN]), many), pa.array(texts, pa.binary()).cast(pa.string())]


def find(docs: DataFrame, *, text: str = "text", least: int = 12, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` plus ``runs`` (array of start, length, period, by start and period; words count from 0) and ``collapsed``:
    the words joined by single spaces, without those that a run contains after its first ``period`` words.

    ``least`` is 12 at least.
    """
    if least < 2 * _SHARED:
        raise ValueError("least must be 12 or more")
    added = T.StructType([T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType())])
    return map_columns(docs, text, lambda column: _found(column, least), added)
