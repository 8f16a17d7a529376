"""Sampled SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is escaped as SentencePiece does (one space in front; a space is the piece character for a word start) and
nothing is normalised. All segmentations of the text into pieces form a lattice; the weight of a piece is
1 / rank ** sharpness, with the rank taken from the model's scores. Forward filtering sums the weights of all paths
to each byte position, backward sampling draws one path from the end with the probability of its weight.

No piece of the model crosses from a letter to a following space, nor touches a character that is in no longer piece
(a line break, say). The lattice therefore falls apart at those places into segments, mostly single words, and
sampling each segment on its own is the same as sampling the whole text. The forward pass runs once per distinct
segment of a block of text, the backward pass once per occurrence, both over whole NumPy arrays.

The random numbers are hashes of (row key, number of the segment in the row, step), so a row's segmentation depends
on its key and text alone, not on batches or partitions. Characters without a piece become byte pieces.

Decoding joins the bytes of the pieces and drops the space in front. decode(encode(text)) is the text.

The model (its path is a parameter) is read once on the driver and broadcast; it is refused above ``most_bytes``.

Defined cases: a null text has null ids and decodes to null, an empty text has no ids; rows with equal key and text
have equal ids; an empty table gives an empty result; added columns replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variascope.llm.words import lists, mix, pack, ragged, slices, word_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK = 1 << 17
_ROWS = 1 << 19
_SPACE = 0x20


class Pieces:
    """The model: what each id spells and, unless ``sharpness`` is None (decoding), a byte trie with weights."""

    def __init__(self, model: bytes, sharpness: float | None):
        loaded = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = loaded.get_piece_size()
        self.spelled: list[bytes] = []
        self.byte_id = np.full(256, -1, np.int64)
        usable = []
        for i in range(n):
            piece = loaded.id_to_piece(i)
            if loaded.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.spelled.append(bytes([value]))
            elif loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_unused(i):
                self.spelled.append(b"")
            else:
                spelled = piece.replace("▁", " ")
                if " " in spelled.lstrip(" "):
                    raise ValueError(f"piece {i} holds a space behind other characters; its lattice has no word boundaries")
                self.spelled.append(spelled.encode())
                usable.append((loaded.get_score(i), i))
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        self.lengths = np.array([len(s) for s in self.spelled])
        self.ends = np.cumsum(self.lengths)
        self.flat = np.frombuffer(b"".join(self.spelled), np.uint8)
        if sharpness is None:
            return
        usable.sort(reverse=True)
        weight = {i: -sharpness * np.log(rank) for rank, (_, i) in enumerate(usable, 1)}
        self.byte_weight = -sharpness * np.log(len(usable) + 1)
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        joined = set()
        for _, i in usable:
            node, spelled = 0, self.spelled[i]
            for b in spelled:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ids.append(-1)
                node = children[node][b]
            ids[node] = i
            if len(spelled) > 1:
                joined.update(spelled)
        # nodes with children come first, so only they have a row in the table of next nodes
        order = sorted(range(len(children)), key=lambda k: (not children[k], k))
        number = {k: at for at, k in enumerate(order)}
        self.inner = sum(1 for below in children if below)
        self.next = np.zeros((self.inner, 256), np.int32)
        for node, below in enumerate(children):
            for b, child in below.items():
                self.next[number[node], b] = number[child]
        self.next = self.next.ravel()
        self.piece = np.array([ids[k] for k in order], np.int64)
        self.weight = np.array([weight.get(ids[k], 0.0) for k in order])
        self.alone = np.array([b not in joined and b < 0x80 and b != _SPACE for b in range(256)])


_loaded: dict[tuple[bytes, float | None], Pieces] = {}


def load(model: bytes, sharpness: float | None) -> Pieces:
    """The tables of a model, made once per process."""
    name = (hashlib.sha256(model).digest(), sharpness)
    if name not in _loaded:
        if len(_loaded) > 1:
            _loaded.clear()
        _loaded[name] = Pieces(model, sharpness)
    return _loaded[name]


def escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with one space in front of each text that is not empty."""
    lengths = np.diff(offsets)
    more = (lengths > 0).astype(np.int64)
    to = np.concatenate([[0], np.cumsum(lengths + more)])
    out = np.full(to[-1], _SPACE, np.uint8)
    out[ragged(to[:-1] + more, lengths)] = data
    return out, to


def segments(data: np.ndarray, offsets: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, first) of the independent parts of the lattice; row r has the segments first[r]:first[r + 1]."""
    space, single = data == _SPACE, alone[data]
    opening = single.copy()
    opening[1:] |= single[:-1] | (space[1:] & ~space[:-1])
    opening[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(opening)
    return starts, np.searchsorted(starts, offsets)


class Lattice:
    """All segmentations of the segments first[k]:first[k + 1] of ``data``; nodes are byte positions plus one end each."""

    def __init__(self, data: np.ndarray, first: np.ndarray, pieces: Pieces):
        lengths = np.diff(first)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        stop = first[1:][owner]
        at = np.arange(len(data))
        node = np.zeros(len(data), np.int64)
        found = []
        char = np.where(data < 0x80, 1, np.where(data < 0xC0, 0, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))))
        bare = char > 0
        length = 0
        while at.size:
            node = pieces.next[node * 256 + data[at + length]].astype(np.int64)
            alive = node > 0
            at, node = at[alive], node[alive]
            length += 1
            ids = pieces.piece[node]
            some = ids >= 0
            if some.any():
                found.append((at[some], np.full(int(some.sum()), length), ids[some], pieces.weight[node[some]]))
                bare[at[some][char[at[some]] == length]] = False
            inside = (at + length < stop[at]) & (node < pieces.inner)
            at, node = at[inside], node[inside]
        lead = np.flatnonzero(bare)
        if lead.size:
            p = ragged(lead, np.minimum(char[lead], stop[lead] - lead))
            found.append((p, np.ones(len(p), np.int64), pieces.byte_id[data[p]], np.full(len(p), pieces.byte_weight)))
        start, size, ids, weight = (np.concatenate(x) for x in zip(*found))
        which = owner[start]
        end_node = start + size + which
        order = np.lexsort((end_node, start + size - first[which]))
        self.source = (start + which)[order]
        self.ids = ids[order]
        end_node, weight, depth = end_node[order], weight[order], (start + size - first[which])[order]
        nodes = len(data) + len(lengths)
        self.begin = first[:-1] + np.arange(len(lengths))
        self.end = self.begin + lengths
        alpha = np.full(nodes, -np.inf)
        alpha[self.begin] = 0.0
        heads = np.flatnonzero(np.append(True, end_node[1:] != end_node[:-1]))
        level = np.searchsorted(depth[heads], np.arange(1, int(depth[-1]) + 2))
        value = np.empty(len(ids))
        bounds = np.append(heads, len(ids))
        for a, b in zip(level[:-1], level[1:]):
            if a == b:
                continue
            lo, hi = bounds[a], bounds[b]
            value[lo:hi] = alpha[self.source[lo:hi]] + weight[lo:hi]
            alpha[end_node[heads[a:b]]] = np.logaddexp.reduceat(value[lo:hi], heads[a:b] - lo)
        share = np.exp(value - alpha[end_node])
        self.sums = np.cumsum(share)
        self.low = np.zeros(nodes, np.int64)
        self.high = np.zeros(nodes, np.int64)
        self.low[end_node[heads]] = heads
        self.high[end_node[heads]] = bounds[1:] - 1

    def sample(self, which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per occurrence) of one path per occurrence of a segment."""
        node, goal, who = self.end[which], self.begin[which], np.arange(len(which))
        steps = []
        many = np.zeros(len(which), np.int64)
        turn = 0
        while who.size:
            u = (mix(seeds[who] + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            low, high = self.low[node], self.high[node]
            before = np.where(low > 0, self.sums[low - 1], 0.0)
            target = before + u * (self.sums[high] - before)
            edge = low.copy()
            moving = np.flatnonzero((self.sums[edge] <= target) & (edge < high))
            while moving.size:
                edge[moving] += 1
                moving = moving[(self.sums[edge[moving]] <= target[moving]) & (edge[moving] < high[moving])]
            steps.append((who, self.ids[edge]))
            many[who] += 1
            node = self.source[edge]
            more = node != goal[who]
            who, node = who[more], node[more]
            turn += 1
        ends = np.cumsum(many)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (at, ids) in enumerate(steps):
            out[ends[at] - 1 - k] = ids
        return out, many


def encode_rows(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per row)."""
    data, offsets = escaped(data, offsets)
    starts, first = segments(data, offsets, pieces.alone)
    rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(rows, np.int64)
    ends = np.append(starts[1:], len(data))
    row = np.repeat(np.arange(rows), np.diff(first))
    seeds = mix(mix(keys[row]) + (np.arange(len(starts)) - first[row]).astype(np.uint64))
    parts, many = [], []
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, side="right")))
        hashes = word_hashes(data, starts[a:b], ends[a:b])
        _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = (ends - starts)[a:b][at]
        flat = data[ragged(starts[a:b][at], lengths)]
        lattice = Lattice(flat, np.concatenate([[0], np.cumsum(lengths)]), pieces)
        ids, n = lattice.sample(which.ravel(), seeds[a:b])
        parts.append(ids)
        many.append(n)
        a = b
    return np.concatenate(parts), np.bincount(row, np.concatenate(many), minlength=rows).astype(np.int64)


def decode_rows(ids: np.ndarray, many: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts."""
    lengths = pieces.lengths[ids]
    data = pieces.flat[ragged(pieces.ends[ids] - lengths, lengths)]
    sums = np.concatenate([[0], np.cumsum(lengths)])
    offsets = sums[np.concatenate([[0], np.cumsum(many)])]
    heads = offsets[:-1][np.diff(offsets) > 0]
    heads = heads[data[heads] == _SPACE]
    keep = np.ones(len(data), bool)
    keep[heads] = False
    return data[keep], offsets - np.searchsorted(heads, offsets)


def model_bytes(path: str, most_bytes: int = 64 << 20) -> bytes:
    if os.path.getsize(path) > most_bytes:
        raise ValueError(f"{path} is larger than {most_bytes} bytes")
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", model: str = MODEL, sharpness: float = 0.5, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (or ``keep``) plus ``ids``, a segmentation of the text sampled with the row's key."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    kept = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    ready = docs.select(F.xxhash64(key).alias("_seed"), F.col(text).alias("_text"), *[F.col(f"`{c}`") for c in kept])

    def run(batches):
        pieces = load(shared.value, sharpness)
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            data, offsets = pack(batch.column(1))
            for i, j in slices(offsets, _ROWS):
                ids, many = encode_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], keys[i:j], pieces)
                made = lists(pa.array(ids.astype(np.int32)), many)
                rows = batch.slice(i, j - i)
                if rows.column(1).null_count:
                    made = pa.ListArray.from_arrays(made.offsets, made.values, mask=rows.column(1).is_null())
                yield pa.RecordBatch.from_arrays([*rows.columns[2:], made], [*kept, "ids"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return ready.mapInArrow(run, schema)


def decode(rows: DataFrame, *, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` plus the text that the ids spell."""
    shared = rows.sparkSession.sparkContext.broadcast(model_bytes(model))
    names = rows.columns
    kept = [c for c in names if c != text]

    def run(batches):
        pieces = load(shared.value, None)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            if not len(column):
                continue
            places = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy()
            for i, j in slices(places - places[0], _ROWS // 4):
                many = np.diff(places[i : j + 1])
                data, offsets = decode_rows(values[places[i] : places[j]].astype(np.int64), many, pieces)
                made = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes())).cast(pa.string())
                rows = batch.slice(i, j - i)
                if column.null_count:
                    made = pc.if_else(column.slice(i, j - i).is_null(), pa.scalar(None, pa.string()), made)
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k, c in enumerate(names) if c != text), made], [*kept, text])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(text, T.StringType())])
    return rows.mapInArrow(run, schema)
