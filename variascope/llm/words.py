"""Words and their hashes over whole Arrow columns, one NumPy pass per slice of a batch.

All word definitions used here separate ASCII characters from everything else, so they can be read off UTF-8
bytes: a byte of 0x80 or more is always part of a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"

_LOWER = bytes(range(256)).lower()
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_BLOCK = 1 << 18


def _table(test: Callable[[int], bool]) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


#: Bytes of ``[^\x20\x09-\x0D]`` and, after lower-casing, of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.
NOT_SPACE = _table(lambda b: b not in SPACES)
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def pack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, everything else as it is."""
    return np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a row is never cut, a longer one stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1))
        yield i, j
        i = j


def stretches(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs of set bytes; row r has the runs first[r]:first[r + 1]."""
    opening, closing = mask.copy(), mask.copy()
    opening[1:] &= ~mask[:-1]
    closing[:-1] &= ~mask[1:]
    head = offsets[:-1][offsets[:-1] < len(mask)]
    opening[head] = mask[head]
    tail = offsets[1:][offsets[1:] > 0] - 1
    closing[tail] = mask[tail]
    starts, ends = np.flatnonzero(opening), np.flatnonzero(closing) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of maximal runs of ``inside`` bytes; row r has the words first[r]:first[r + 1]."""
    return stretches(inside[data], offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, _BLOCK), base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if n <= _BLOCK:
            _powers[base] = known
    return known[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, in blocks so that memory follows the number of words."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        low = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, low + _BLOCK, side="right")))
        high = ends[b - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers(_STEP, high - low), out=sums[1:])
        at, to = starts[a:b] - low, ends[a:b] - low
        out[a:b] = (sums[to] - sums[at]) * powers(_BACK, high - low)[at] + (to - at).astype(np.uint64)
        a = b
    return mix(out)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes, across rows too: the caller keeps the positions it wants."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        total = total * np.uint64(_STEP) + hashes[k : len(hashes) - n + 1 + k]
    return mix(total)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + lengths[i] - 1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    jump = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return jump + np.arange(total)


def lists(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each row."""
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), values).cast(
        pa.list_(values.type)
    )


def map_columns(
    df: DataFrame, text: str, make: Callable[[pa.Array], list[pa.Array]], added: T.StructType, keep: list[str] | None = None
) -> DataFrame:
    """Columns of ``df`` (or ``keep``) plus those that ``make`` derives from whole texts, one Arrow batch at a time.

    A column of ``df`` with the name of an added one is replaced by it.
    """
    names = [f.name for f in added]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    needed = list(dict.fromkeys([*kept, text]))

    def run(batches):
        for batch in batches:
            table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            made = make(table[text])
            yield pa.RecordBatch.from_arrays([*(table[c] for c in kept), *made], [*kept, *names])

    schema = T.StructType([*(df.schema[c] for c in kept), *added])
    return df.select(*[f"`{c}`" for c in needed]).mapInArrow(run, schema)
