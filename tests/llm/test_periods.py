"""Run detection against a direct search."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm import brute
from tests.oracle import connect
from variascope.llm import periods

FOLDER = "/root/testdata/sf0.001"


def smallest_period(words):
    fail = [0] * (len(words) + 1)
    k = 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = fail[k]
        k += words[i] == words[k]
        fail[i + 1] = k
    return len(words) - fail[-1]


def direct(words, least=12):
    """[(start, length, period)] by looking at every period."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q) and smallest_period(words[i : j + q]) == q:
                out.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {w for s, n, q in runs for w in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t", "one", "x " * 11, "x " * 12, "x " * 500, "ab c " * 6, " a b c d e f g" * 2, "é ü " * 40]
    for _ in range(150):
        words = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(0, 3)):
            at, n, times = rng.randrange(len(words)), rng.randint(1, 15), rng.randint(2, 6)
            words[at:at] = words[at : at + n] * times
        out.append(" ".join(words))
    fib = ["a", "b"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    out += [" ".join(fib[-1]), "\t".join(f"w{k % 997}" for k in range(20_000))]
    thue = [bin(k).count("1") % 2 for k in range(3000)]
    return [*out, " ".join("ab"[k] for k in thue), " ".join(f"{k % 7}" for k in range(5000)) + " end " + "y " * 4000]


def docs(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)


def test_runs_and_collapsed_texts(spark):
    rows = texts()
    for r in periods.find(docs(spark, rows)).collect():
        words = brute.RUN.findall(rows[r.doc_id] or "")
        if len(words) < 2000:
            want = direct(words)
        elif "w0" in words:
            want = [(0, 20_000, 997)]
        elif "end" in words:
            want = [(0, 5000, 7), (5001, 4000, 1)]
        else:  # overlap-free sequence: squares of 2 ** k and 3 * 2 ** k words only
            want = [tuple(x) for x in r.runs]
            assert {x.period for x in r.runs} == {p for k in range(10) for p, first in ((2**k, 1), (3 * 2**k, 11)) if p >= 6 and first * 2**k + 2 * p <= 3000}
            assert all(x.length == 2 * x.period for x in r.runs)
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed == collapsed(words, want)


def test_more_than_one_slice(spark, monkeypatch):
    rows = texts()[:80]
    column = docs(spark, rows).coalesce(1).toArrow().column("text").combine_chunks()
    whole = [v.to_pylist() for v in periods._found(column, 12)]
    monkeypatch.setattr(periods, "slices", lambda offsets: ((k, k + 1) for k in range(len(offsets) - 1)))
    assert [v.to_pylist() for v in periods._found(column, 12)] == whole


def test_grammar_is_repair():
    """The most frequent pair goes first, and no pair is left twice."""
    words = np.array([0, 1, 2, 0, 1, 3, 0, 1, 2, 4, 4, 4, 4, 4])
    (place, _), (a, m, b), (sizes, puts) = periods.repair(words.copy(), np.zeros(len(words), np.int64))
    assert [*zip(a, m, b, sizes)][0] == (0, 1, 2, 3)
    assert (0, 2, 3, 2) in [*zip(a, m, b, sizes)] and (9, 10, 11, 2) in [*zip(a, m, b, sizes)]
    assert place.tolist() == [0, 3, 5, 6, 9, 11, 13]
    assert sorted(puts.tolist()) == [0, 0, 3, 6, 6, 9, 11]


def test_empty_tables_and_clashing_columns(spark):
    rows = docs(spark, ["x " * 20, None]).withColumns({"runs": F.lit("own"), "start": F.lit(1), "_h": F.lit(2)})
    found = periods.find(rows.unionByName(rows))
    assert found.columns == ["doc_id", "text", "start", "_h", "runs", "collapsed"] and found.count() == 4
    assert periods.find(rows, runs="found").where("runs = 'own'").count() == 2
    assert periods.find(rows.where("false")).count() == 0
    with pytest.raises(ValueError):
        periods.find(rows, least=5)


def test_query(spark):
    rows = {r.doc_id: r for r in entry.queries()["op11_runs"](spark, FOLDER).collect()}
    want = connect(FOLDER).execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(rows) == len(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for key, text in want:
        words = brute.RUN.findall(text or "")
        h, n = zlib.crc32(str(key).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = direct(words)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        r = rows[key]
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(runs), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
