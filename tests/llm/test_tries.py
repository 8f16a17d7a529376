"""N-gram Jaccard join against a comparison of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm import brute
from tests.llm.test_operators import VOCABULARY, empty, odd_texts, prose, table
from tests.oracle import compare, connect
from variascope.llm import tries

FOLDER = "/root/testdata/sf0.001"


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + rng.randint(0, 1)] = [rng.choice(VOCABULARY)] * rng.randint(0, 2)
    return words


def crowd(seed=3):
    """Near copies at and around the threshold, excerpts, shared passages, short texts."""
    rng = random.Random(seed)
    texts = odd_texts()
    for group in range(6):
        words = prose(rng.choice([12, 30, 90, 200]), 100 + group).split()
        for _ in range(25):
            texts.append(" ".join(edited(words, rng, rng.choice([0, 1, 1, 2, 3, 6]))))
    passage = prose(40, 8)
    texts += [f"{prose(rng.randint(1, 60), 500 + k)} {passage} {prose(rng.randint(1, 6), 600 + k)}" for k in range(40)]
    texts += ["a b", "A B", "a b c", "a b c d", "a", None, "", passage.upper()]
    words = prose(60, 77).split()
    for _ in range(40):  # a chain, each close to the next only
        words = edited(words, rng, 1)
        texts.append(" ".join(words))
    return texts


def rows_of(found):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())


@pytest.mark.parametrize("percent, size, turns, block, members", [(90, 3, 1, 250_000, 2000), (90, 3, 0, 500, 7), (70, 2, 2, 300, 10)])
def test_components(spark, monkeypatch, percent, size, turns, block, members):
    monkeypatch.setattr(tries, "_TURNS", turns)
    monkeypatch.setattr(tries, "_BLOCK", block)
    monkeypatch.setattr(tries, "_MEMBERS", members)
    texts = crowd()
    assert rows_of(tries.classes(table(spark, texts), percent=percent, size=size)) == brute.components(list(enumerate(texts)), percent, size)


def test_walk_finds_all_pairs(monkeypatch):
    monkeypatch.setattr(tries, "_STATES", 50)
    rng = random.Random(1)
    base = [sorted(rng.sample(range(300), 60)) for _ in range(4)]
    sets = {tuple(sorted(set(rng.sample(b, rng.randint(50, 60)) + rng.sample(range(300), rng.randint(0, 6))))) for b in base for _ in range(40)}
    sets = [*sets, (1,), (1, 2), (1, 2, 3), tuple(range(90)), tuple(range(100))]
    cuts = np.cumsum([0, *map(len, sets)])
    flat = np.concatenate(sets).astype(np.int64)
    unit, group = np.arange(len(sets)) % 2, np.arange(len(sets))
    got = {*zip(*(v.tolist() for v in tries.Trie(unit, cuts, flat, group).walk(unit, cuts, flat, group, 80)))}
    close = lambda a, b: 100 * len({*a} & {*b}) >= 80 * len({*a} | {*b})
    assert {(a, b) for a, b in got if a != b} == {(a, b) for a in group for b in group if a != b and unit[a] == unit[b] and close(sets[a], sets[b])}
    # nothing is looked at inside one component
    assert not len(tries.Trie(unit, cuts, flat, group * 0).walk(unit, cuts, flat, group * 0, 80)[0])


def test_null_ids_repeats_columns_and_empty_tables(spark):
    text = prose(40, 4)
    docs = table(spark, [text, text + " end", prose(40, 5)]).withColumns({"component_id": F.lit("own"), "n": F.lit(3), "token": F.lit(0), "_id": F.lit("x")})
    docs = docs.unionByName(docs).unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    rows = tries.classes(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [(0, 0)] * 2 + [(1, 0)] * 2 + [(2, 2)] * 2
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert tries.classes(empty(spark)).count() == 0


def test_query(spark):
    assert compare(entry.queries()["op13_jaccard_join"](spark, FOLDER), connect(FOLDER), entry.oracle_sql()["op13_jaccard_join"]) is None


def test_shingles_are_stored_once_and_copies_alone_are_shuffled(spark, monkeypatch):
    stored = []
    keep = tries.written
    monkeypatch.setattr(tries, "written", lambda df, name: stored.append((name, df.columns)) or keep(df, name))
    texts = [prose(40, k % 30) for k in range(60)] + crowd()
    assert rows_of(tries.classes(table(spark, texts))) == brute.components(list(enumerate(texts)), 90, 3)
    assert [name for name, columns in stored if "low" in columns] == ["sketches"]
    made = tries.sketches(table(spark, texts), key="doc_id", text="text", size=3, percent=90)
    least = made.where("n > 0").groupBy("n", "p1", "p2").agg(F.min("_id").alias("_id"))
    found = tries.representatives(made, least)
    assert sorted(r[0] for r in found.select("_id").collect()) == sorted(r[0] for r in least.select("_id").collect())
