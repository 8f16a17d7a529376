"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of word characters and runs of punctuation, case kept; features are the tokens, pairs of neighbours
(a token followed by itself is one feature for all tokens) and pairs of token shapes, hashed to ``2 ** bits`` slots. A document's value in a slot is 1 / (number of its slots) ** 0.35 when the
feature occurs, so a score is one sparse dot product per document whatever its length.

Training: up to ``sample`` labelled documents (the documented bound; the smallest hashes of the row key), dealt by
hash to groups of about ``group``. Each group runs FTRL-Proximal over ``epochs`` passes in one task; the models are averaged.
A task holds one group, so it is bounded by the parameter, not by the data. The model has at
most ``2 ** bits`` non-zero weights and is broadcast.

Defined cases: null and empty texts have the bias as their only feature and get its score; labels without a
document, with a null id or null label are ignored; of several labels for one id the lowest counts; without any
labelled rows every score is 0.5. Ids, source and language are never features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variascope.llm.io import written
from variascope.llm.words import SLICE, map_columns, mix, ngrams, pack, slices, word_hashes

_WORD, _PUNCT = 1, 2
#: Power of the number of features by which a document's values are scaled down.
_DAMP = 0.35
#: One feature for any token that follows itself.
_TWICE = np.uint64(0x5851F42D4C957F2D)
_KIND = np.array(
    [_WORD if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else _PUNCT if 0x21 <= b <= 0x7E else 0 for b in range(256)],
    np.int8,
)


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """A code per token: single punctuation by itself, longer runs, words in capitals, words with digits, other words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    bounds = np.stack([starts, ends], axis=1).ravel()
    count = lambda flag: np.add.reduceat(np.append(flag, False).astype(np.int32), bounds)[::2]
    capitals, digits = count((data >= 0x41) & (data <= 0x5A)), count((data >= 0x30) & (data <= 0x39))
    length = ends - starts
    word = kind[starts] == _WORD
    code = np.where(length > 1, 256, data[starts].astype(np.int64))
    return np.where(word, np.where(digits > 0, 257, np.where((capitals > 1) & (2 * capitals > length), 258, 259)), code).astype(np.uint64)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, slots per row): the distinct feature slots of each row; slot 0 is the bias of every row."""
    kind = _KIND[data]
    change = np.empty(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[:-1][offsets[:-1] < len(kind)]] = True
    cut = np.flatnonzero(change)
    ends = np.append(cut[1:], len(kind)).astype(np.int64)
    some = kind[cut] > 0
    starts, ends = cut[some], ends[some]
    first = np.searchsorted(starts, offsets)
    tokens = word_hashes(data, starts, ends)
    rows = len(offsets) - 1
    n = np.diff(first)
    owner = np.repeat(np.arange(rows), n)
    shape = shapes(data, starts, ends, kind)
    pairs = np.where(tokens[1:] == tokens[:-1], _TWICE, ngrams(tokens, 2))
    looks = ngrams(shape, 2)
    inside = owner[1:] == owner[:-1]
    slots = np.concatenate([tokens, mix(pairs[inside]), mix(looks[inside]), np.zeros(rows, np.uint64)]) >> np.uint64(64 - bits)
    owners = np.concatenate([owner, owner[1:][inside], owner[1:][inside], np.arange(rows)])
    key = np.sort((owners.astype(np.uint64) << np.uint64(bits)) | slots)
    key = key[np.append(True, key[1:] != key[:-1])]
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), np.bincount((key >> np.uint64(bits)).astype(np.int64), minlength=rows)


def train_rows(rows, bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-Proximal over (slots, label) pairs in the given order; (slots, weights) of the non-zero weights."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, label in rows:
            x = len(at) ** -_DAMP
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum() * x, -35, 35)))
            g = (p - label) * x
            old = n[at]
            z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
            n[at] = old + g * g
    every = np.arange(1 << bits)
    w = weights(every)
    return every[w != 0], w[w != 0]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    learn: Column | None = None,
    sample: int = 16_000,
    group: int = 4_000,
    bits: int = 20,
    epochs: int = 5,
    alpha: float = 4.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.005,
) -> np.ndarray:
    """Weights (2 ** bits) learned from the labelled documents; ``learn`` restricts the label rows."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    chosen = (
        rows.groupBy(key).agg(F.min(label).cast("double").alias("_label")).orderBy(F.xxhash64(key), key).limit(sample)
    )
    chosen = written(chosen, "sample")
    shards = max(1, round(chosen.count() / group))
    texts = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    joined = texts.join(F.broadcast(chosen), key).select(
        "_text", "_label", F.pmod(F.xxhash64(key), F.lit(shards)).alias("_shard"), F.xxhash64(key, F.lit(1)).alias("_order")
    )

    def make(column):
        data, offsets = pack(column)
        parts = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits) for i, j in slices(offsets)]
        many = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        at = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
        raw = at.astype(np.int32)
        return [pa.array([raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())]

    ready = map_columns(joined, "_text", make, T.StructType([T.StructField("_slots", T.BinaryType())]), ["_label", "_shard", "_order"])

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_order", kind="stable")
        pairs = [(np.frombuffer(s, np.int32), y) for s, y in zip(rows["_slots"], rows["_label"])]
        at, w = train_rows(pairs, bits, epochs, alpha, beta, l1, l2)
        return pd.DataFrame({"slot": at, "weight": w})

    model = np.zeros(1 << bits)
    learned = ready.groupBy("_shard").applyInPandas(train, "slot long, weight double")
    for part in learned.groupBy("slot").agg((F.sum("weight") / shards).alias("weight")).toArrow().to_batches():
        model[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return model


def scores(column: pa.Array, model: np.ndarray) -> np.ndarray:
    bits = int(np.log2(len(model)))
    data, offsets = pack(column)
    out = np.zeros(len(offsets) - 1)
    for i, j in slices(offsets, SLICE):
        at, many = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
        ends = np.cumsum(many)
        out[i:j] = np.add.reduceat(model[at], ends - many) * many.astype(float) ** -_DAMP
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, model: np.ndarray, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep``) plus ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_columns(
        docs, text, lambda column: [pa.array(scores(column, shared.value))], T.StructType([T.StructField("score", T.DoubleType())]), keep
    )
