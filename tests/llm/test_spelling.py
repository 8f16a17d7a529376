"""Spelling variants against a direct search over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm import brute
from tests.oracle import compare, connect
from variascope.llm import spelling

FOLDER = "/root/testdata/sf0.001"


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def direct(counts, times=5):
    out = []
    form = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if apart_by_one(w, v)]
        best = min(near, default=None)
        if best and -best[0] >= times * n:
            form[w] = best[1]
        out.append((w, n, len(near)))
    rows = []
    for w, n, many in out:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, many, counts[form[w]] if w in form else None))
    return sorted(rows)


def words(seed=1, n=400):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "".join(rng.choice("abcé" if rng.random() < 0.7 else "abcdefghß") for _ in range(rng.randint(6, 12)))
        many = rng.choice([5, 6, 30, 200, 1000, 6000])
        out[w] = many
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1 :]])
            if len(w) >= 6:
                out.setdefault(w, rng.choice([5, many, max(5, many // 5)]))
    return out


def rows_of(found):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect())


@pytest.mark.parametrize("options", [{}, {"shard": 300}, {"shard": 500, "crowd": 7}])
def test_variants(spark, options):
    counts = words()
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.variants(table, **options)) == direct(counts)


def test_chains_ties_and_repeated_letters(spark):
    counts = {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "baaaaaa": 25, "lonely": 9, "aaaaab": 24}
    counts |= {"x" * 3000: 7, "x" * 2999: 70, "éééééé": 5, "ééééée": 25, "èééééé": 25}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows_of(spelling.variants(table))
    assert got == direct(counts)
    assert next(r for r in got if r[0] == "aaaaaa")[1:3] == ("aaaaaaa", "aaaaaaaaa")
    assert spelling.variants(table.where("false")).count() == 0


def test_index_intervals():
    some = sorted(words(5, 60))
    index = spelling.Index(some)
    q, w = index.one_error(some, np.array([len(x) - len(x) // 2 for x in some]))
    got = {(some[a], some[b]) for a, b in zip(q, w)}
    want = {(a, b) for a in some for b in some if apart_by_one(a, b) and b.endswith(a[len(a) // 2 :])}
    assert got == want


def counted(rows, noise, least=5):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if noise and key is not None and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 6
    return {w: n for w, n in found.items() if n >= least}


@pytest.mark.parametrize("noise", [None, 3])
def test_vocabulary(spark, noise):
    rng = random.Random(2)
    known = [*words(3, 40), "Straße", "ÀÉÎÕÜ÷×", "abcƀdef", "日本語日本語", "Ω" * 7, "x" * 900, "Ünïcödé"]
    texts = [None, "", "...", *(rng.choice(" \n.1-").join(rng.choices(known, k=rng.randint(1, 60))) for _ in range(200))]
    texts += ["é" * 6 + "Ā" + "a" * 6] * 5 + ["ABCDEF"] * 5
    rows = [*enumerate(texts), (None, "abcdefg abcdefg " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"word": F.lit("own"), "n": F.lit("own")})
    got = {r.word: r.n for r in spelling.vocabulary(docs, noise=noise).collect()}
    assert got == counted(rows, noise)
    assert spelling.vocabulary(docs.where("false"), noise=noise).count() == 0


def test_checksums():
    words_ = [b"a", b"hello", b"x" * 300, b"\xc3\xa9" * 5]
    data = np.frombuffer(b"".join(words_), np.uint8)
    ends = np.cumsum([len(w) for w in words_])
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in range(4)])
    got = spelling.checksums(data, ends - [len(w) for w in words_], ends, before)
    assert got.tolist() == [zlib.crc32(f"{k}:".encode() + w) for k, w in enumerate(words_)]


def test_query(spark):
    assert compare(entry.queries()["op12_spelling"](spark, FOLDER), connect(FOLDER), entry.oracle_sql()["op12_spelling"]) is None
    rows = connect(FOLDER).execute("SELECT doc_id, text FROM documents").fetchall()
    assert rows_of(entry.queries()["op12_spelling"](spark, FOLDER)) == direct(counted(rows, 199))
