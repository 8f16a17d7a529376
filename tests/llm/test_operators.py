"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from variascope.llm import bloom, decontaminate, exact, licenses, near, passages, pieces, pii, quality, shards, warc
from variascope.llm.text_queries import remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def table(spark, texts, schema=DOCS, partitions=3):
    rows = [(k, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(partitions)


def odd_texts():
    """Null, empty, blank, one word, long, equal and almost equal texts."""
    base = prose(120, 1)
    words = base.split()
    close = " ".join([*words[:60], "changed", *words[61:]])
    return [None, "", " \n\t", "one", "one", base, base + " ", base.upper(), close, prose(30_000, 2), prose(3, 3), "ünï çödé 日本語 " * 8]


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def test_exact_groups(spark):
    texts = [*odd_texts(), "a b", "ab", "a  b", "ab", None]
    got = sorted(tuple(r) for r in exact.groups(table(spark, texts)).collect())
    assert got == brute.exact(list(enumerate(texts)))
    assert exact.groups(empty(spark)).count() == 0


def test_exact_deduplicate_repeats_and_clashing_columns(spark):
    texts = ["x y", "xy", "xy", None, "", "z"]
    docs = table(spark, texts).withColumns({"keep_id": F.lit("own"), "kept": F.lit(None).cast("int"), "word": F.lit(1), "mask": F.lit(2)})
    docs = docs.unionByName(docs).unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 5]
    flags = [r.kept for r in exact.groups(docs).collect()]
    assert len(flags) == 13 and sum(flags) == 3


def test_bloom_holds_all_repeats_and_little_else(spark):
    rows = spark.range(4000).select((F.col("id") % 3900).alias("k"))
    bits = bloom.bits_for(4000)
    words = bloom.repeated(rows, "k", bits)
    flagged = bloom.flag(rows, "k", words, bits, "maybe").where("maybe").select("k").collect()
    assert {r.k for r in flagged} >= set(range(100)) and len(flagged) < 600
    assert bloom.bits_for(10**12) == bloom.MOST_BITS


def test_near_components(spark):
    texts = odd_texts()
    rng = random.Random(5)
    for group in range(4):
        words = prose(90, 50 + group).split()
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            texts.append(" ".join(copy))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near.classes(table(spark, texts)).collect())
    assert got == brute.components(list(enumerate(texts)))
    assert near.classes(empty(spark)).count() == 0


def test_near_crowded_keys_are_worked_off(spark):
    """A chain of texts in which each is close to its neighbours only, in keys with many members."""
    words = prose(400, 9).split()
    texts = []
    for step in range(40):
        words = list(words)
        for k in range(4):
            words[(step * 10 + k * 97) % len(words)] = f"new{step}x{k}"
        texts.append(" ".join(words))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near.classes(table(spark, texts)).collect())
    assert got == brute.components(list(enumerate(texts)))


def test_near_full_copies_among_shorter_excerpts(spark):
    """Two full near copies link although every key they share has a smaller id and a size that neither can match."""
    words = prose(104, 11).split()
    rng = random.Random(12)
    texts = []
    for _ in range(250):
        a, b = rng.randrange(0, 40), rng.randrange(54, 92)
        texts.append(" ".join(words[:a] + words[a + 12 : b] + words[b + 12 :]))
    texts += [" ".join(words), " ".join([*words[:103], "changed"])]
    want = brute.components(list(enumerate(texts)))
    assert want[-1][2] == want[-2][2] == 250
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near.classes(table(spark, texts)).collect())
    assert got == want


def test_near_null_ids_repeats_and_columns(spark):
    text = prose(40, 4)
    docs = table(spark, [text, text + " end", prose(40, 5)]).withColumns({"component_id": F.lit("own"), "n": F.lit(3), "key": F.lit(0)})
    docs = docs.unionByName(docs).unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    rows = near.classes(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in rows if r.doc_id is not None) == [(False, 0, 0)] * 2 + [(False, 1, 0)] * 2 + [(False, 2, 2)] * 2
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [(False, 0)] * 2 + [(False, 2)] * 2


def test_tensored_keys_need_few_hashes():
    values = np.arange(1000, dtype=np.uint64)
    sig, prints = near.signatures(values, np.array([0, 500, 500, 1000]), 10)
    assert sig.shape == (3, 20) and not sig[1].any() and prints[0, 0] != prints[2, 0]


ITEMS = "item_id long, text string"


def test_near_counts_recurring_shingles_exactly(spark):
    texts = ["a b c d e f g", "x b c d e f y", "k l m n o p q", "a b c d e", None, ""]
    docs = table(spark, texts)
    found = near.recurring(docs, docs.select(F.col("doc_id").alias("_id")), key="doc_id", text="text", size=3)
    assert {r["_id"]: r["v"] for r in found.collect()} == {0: 4, 1: 3, 3: 3}


def test_near_makes_keys_of_shared_pieces_only(spark):
    texts = [prose(80, 300 + k) for k in range(40)] + [prose(80, 300) + " end"]
    made = near.sketches(table(spark, texts), key="doc_id", text="text", size=5, pieces=10)
    keys = near.keyed(made, 10)
    # texts of their own make none of their 100 keys
    assert {r["_id"] for r in keys.select("_id").distinct().collect()} == {0, 40}
    both = keys.groupBy("key").count().where("count > 1").count()
    full = sum(a == b for a, b in zip(*[r.sig[:10] for r in made.where("_id in (0, 40)").collect()])) * sum(
        a == b for a, b in zip(*[r.sig[10:] for r in made.where("_id in (0, 40)").collect()])
    )
    assert both == full > 0


def test_contamination(spark):
    item = prose(24, 20)
    words = item.split()
    items = [(1, item), (2, "Short item, HERE"), (3, None), (4, ""), (5, item), (None, prose(15, 21)), (10, "solo")]
    texts = [
        *odd_texts(),
        prose(50, 22) + " " + item.upper() + "! " + prose(30, 23),
        " ".join(words[3:13]),
        " ".join(words[3:12]),
        "x short;item\nhere solo",
        prose(15, 21),
        " ".join(words[:10] + words[5:15]),
    ]
    docs = table(spark, texts).withColumns({"n_hit": F.lit("clash"), "more": F.lit(1)})
    benchmark = spark.createDataFrame(items, ITEMS).withColumn("n_words", F.lit(0))
    want = brute.contamination(list(enumerate(texts)), items)
    for most in (32 << 20, 200):  # one block of items, and several
        found = decontaminate.scan(docs, benchmark, max_item_bytes=most)
        assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "more", "n_words", "n_hit", "hit_items", "hit_spans"]
        rows = found.collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in rows) == want
        assert all(sum(s.last - s.first + 1 for s in r.hit_spans) == r.n_hit for r in rows)
    clean = decontaminate.clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [w[0] for w in want if not w[2]]
    assert decontaminate.scan(empty(spark), benchmark).count() == 0
    assert not decontaminate.scan(docs, empty(spark, ITEMS)).where("n_hit > 0").count()


def test_shift_tables_skip():
    """Blocks of no pattern move the window by the full step, blocks of a pattern by their distance to its end."""
    _, tables = decontaminate.build([("1", prose(14, 30))], 10)
    assert [t.size for t in tables] == [10] and set(np.unique(tables[0].shift)) == set(range(9))


def test_shards(spark):
    texts = [prose(RNG.randint(0, 60), 100 + k) for k in range(400)] + [None, "", prose(900, 3)] + ["same text"] * 200
    docs = table(spark, texts).withColumns({"size": F.lit("own"), "shard": F.lit("own"), "source": F.when(F.col("doc_id") % 3 > 0, "hot")})
    rows = shards.assign(docs, shards=24).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    total = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
        total.setdefault(r.shard, []).append(r)
    assert sorted(total) == list(range(24))
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in total.values())
    sizes = [sum(r["size"] for r in part) for part in total.values()]
    largest = max(r["size"] for r in rows)
    assert max(sizes) - min(sizes) <= 2 * largest
    assert shards.assign(empty(spark), shards=24).count() == 0
    few = shards.assign(table(spark, ["a", "b", "b"]).unionByName(table(spark, ["a", "b", "b"])), shards=4).collect()
    assert len(few) == 6 and {r.shard for r in few} <= set(range(4))


def test_shards_written(spark, tmp_path):
    source = str(tmp_path / "docs")
    table(spark, [prose(20, k) for k in range(50)]).write.parquet(source)
    docs = spark.read.parquet(source)
    placed = shards.write(docs, str(tmp_path / "out"), shards=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = sorted((r.doc_id, r.shard, r.slot) for r in placed.collect())
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == want
    assert sorted(r.text for r in back.collect()) == sorted(r.text for r in docs.collect())


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 1500 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a.example/x y\r\nz", big), (2, "http://b", big), (3, None, big), (4, "http://c", None), (5, "http://d", ""), (6, "u", "small"), (7, "u", "small")]
    rows += [(None, "http://n", big), (3, "again", big), (8, "long", prose(60_000, 1))]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit("own"), "offset": F.lit(1)}).repartition(3)
    index, folder = warc.write(pages, archive_bytes=4000)
    assert index.count() == len(rows) and index.select("archive").distinct().count() > 3
    got = warc.read(index, folder).collect()
    bodies = sorted((r[0] or -1, hashlib.sha1((r[2] or "").encode()).hexdigest(), len((r[2] or "").encode())) for r in rows)
    assert sorted((r.page_id or -1, r.payload_digest, r.payload_bytes) for r in got) == bodies
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to or 0) for r in got)
    assert kinds == [(-1, "revisit", 3), (1, "revisit", 3), (2, "revisit", 3), (3, "response", 0), (3, "response", 0)] + [(k, "response", 0) for k in (4, 5, 6, 7, 8)]
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {big, "", "small", rows[-1][2]}
    picked = warc.read(index.where("page_id in (3, 6)"), folder).collect()
    assert sorted(r.page_id for r in picked) == [3, 3, 6]
    none, where = warc.write(empty(spark, PAGES))
    assert none.count() == 0 and warc.read(none, where).count() == 0


def test_warc_reads_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 40, 5), ("a", 500, 5), ("b", 505, 5)]
    assert list(warc.ranges(rows, 25, 1000)) == [("a", 0, 45, [0, 1, 2]), ("a", 500, 505, [3]), ("b", 505, 510, [4])]
    assert len(list(warc.ranges(rows, 1000, 20))) == 4


def cartesian(values, t):
    """All (l, c, r) by definition, for the leftmost minimum."""
    out = []
    for c, v in enumerate(values):
        l = c
        while l > 0 and values[l - 1] > v:
            l -= 1
        r = c
        while r + 1 < len(values) and values[r + 1] >= v:
            r += 1
        if r - l + 1 >= t:
            out.append((l, c, r))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_compact_windows(seed):
    rng = np.random.default_rng(seed)
    lengths = [0, 3, 60, 1, 200]
    values = rng.integers(0, 12 if seed % 2 else 10**9, sum(lengths)).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    left, c, right = passages.compact_windows(values, first, 7)
    want = [(l + f, k + f, r + f) for f, n in zip(first, lengths) for l, k, r in cartesian(values[f : f + n].tolist(), 7)]
    assert sorted(zip(left.tolist(), c.tolist(), right.tolist())) == sorted(want)
    s, at = passages.cuts(values, first, 7)
    for f, n in zip(first, lengths):
        for start in range(f, f + n - 6):
            k = np.searchsorted(s, start, side="right") - 1
            assert at[k] == start + int(np.argmin(values[start : start + 7]))


def test_passages(spark):
    shared, other = prose(60, 40), prose(55, 41)
    words = shared.split()
    close = " ".join([*words[:30], "changed", *words[31:]])
    texts = [
        *odd_texts(),
        prose(80, 42) + " " + shared + " " + prose(20, 43),
        prose(10, 44) + "\n" + shared.upper() + "\n" + prose(70, 45),
        prose(90, 46) + " " + close,
        other,
        prose(44, 47) + " " + other,
        prose(60, 48) + " " + " ".join(words[:49]) + " " + prose(60, 49),
        "word " * 300,
        "word " * 280 + prose(30, 50),
    ]
    n = len(odd_texts())
    rows = passages.shared(table(spark, texts).withColumn("other_id", F.lit("own"))).collect()
    linked = {(r.doc_id, r.other_id) for r in rows}
    assert {(n + 1, n), (n + 2, n), (n + 4, n + 3), (6, 5), (7, 5), (8, 5), (n + 7, n + 6)} <= linked
    assert not {n + 5, 0, 1, 2, 3, 4, 9, 10} & {x for pair in linked for x in pair}
    for r in rows:
        assert r.last_word - r.first_word >= 49 and r.similarity >= 0.8
    span = next(r for r in rows if r.doc_id == n + 1)
    assert span.first_word == 10 and span.last_word == 69 and span.other_first == 80
    assert passages.shared(empty(spark)).count() == 0
    cut = {r.doc_id: r.text for r in passages.remove(table(spark, texts)).collect()}
    assert cut[n] == texts[n] and shared.upper().split()[0] not in (cut[n + 1] or "") and cut[n + 5] == texts[n + 5]


def tokens_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return passages.tokens(data, np.array([0, len(data)]), 5)[0]


@pytest.mark.parametrize("at", [8, 20, 30, 45, 52])
@pytest.mark.parametrize("edit", ["insert", "delete", "replace"])
def test_passage_regions_across_one_edit(at, edit):
    """A passage of 60 words stays one region when a word is inserted, deleted or replaced anywhere."""
    words = prose(60, 90).split()
    other = words[:at] + ([] if edit == "delete" else ["edited"]) + words[at + (edit != "insert") :]
    x, y = prose(40, 91) + " " + " ".join(words) + " " + prose(30, 92), prose(70, 93) + " " + " ".join(other) + " " + prose(10, 94)
    for one, two, a, c, n, m in ((x, y, 40, 70, 60, len(other)), (y, x, 70, 40, len(other), 60)):
        found = passages.regions(tokens_of(one), tokens_of(two), 46, 80)
        assert [r[:4] for r in found] == [(a, a + n - 5, c, c + m - 5)]
        assert found[0][4] >= 0.8


def test_passages_at_the_threshold_are_met(spark):
    """Passages of 50 words with one replaced word, at a similarity just over 0.8, of 200 pairs of documents."""
    texts = []
    for k in range(200):
        words = prose(50, 2000 + k).split()
        at = 5 + k % 40
        other = [*words[:at], "edited", *words[at + 1 :]]
        texts += [f"{prose(20, 3000 + k)} {' '.join(words)} {prose(30, 4000 + k)}", f"{prose(30, 5000 + k)} {' '.join(other)} {prose(20, 6000 + k)}"]
    rows = passages.shared(table(spark, texts)).collect()
    assert {(r.other_id, r.doc_id) for r in rows} >= {(2 * k, 2 * k + 1) for k in range(200)}


def test_passages_neither_end_of_a_key_has(spark, monkeypatch):
    """One key for all documents, the first and the last of which share nothing with the eleven pairs between."""
    middle = [f"{prose(10 + k % 7, 8000 + k)} {prose(60, 8100 + k % 11)}" for k in range(22)]
    texts = [prose(70, 8200), *middle, prose(70, 8201)]
    one = lambda docs, *, key, text, **_: docs.where(f"{key} IS NOT NULL").select(F.lit(1).cast("long").alias("_key"), F.col(key).alias("_id"))
    monkeypatch.setattr(passages, "keyed", one)
    rows = passages.shared(table(spark, texts)).collect()
    assert sorted((r.other_id, r.doc_id) for r in rows) == [(k, k + 11) for k in range(1, 12)]


@pytest.mark.parametrize("places", [False, True])
def test_passages_beside_those_of_the_smallest_document(spark, monkeypatch, places):
    """One key for three documents; what two of them share is met though one, or both, share another passage with the smallest."""
    one, two, first = prose(60, 8300), prose(60, 8301), prose(60, 8302)
    texts = [f"{first} {prose(20, 8303)}", f"{first} {prose(80, 8304)} {one} {two}", f"{two} {one} {prose(80, 8305)}" + (f" {first}" if places else "")]

    def keyed(docs, *, key, text, **_):
        rows = docs.select(F.lit(1).cast("long").alias("_key"), F.col(key).alias("_id"))
        at = F.element_at(F.array(F.lit(0), F.lit(145), F.lit(65)), (F.col("_id") + 1).cast("int"))
        return rows.withColumns({"_from": at, "_to": at + 3}) if places else rows

    monkeypatch.setattr(passages, "keyed", keyed)
    found = {(r.other_id, r.doc_id, r.first_word) for r in passages.shared(table(spark, texts)).collect()}
    assert found == {(0, 1, 0), (1, 2, 0), (1, 2, 60)} | ({(0, 2, 200), (1, 2, 200)} if places else set())


def test_passage_keys_of_recurring_stretches_only(spark):
    """Keys come from stretches of which enough recurs elsewhere; a crowd that shares a key but no passage with its smallest is met."""
    same = prose(70, 8400)
    texts = [prose(400, 8401), f"{prose(300, 8402)} {same}", f"{same} {prose(300, 8403)}", "word " * 200 + "end " * 100]
    docs = table(spark, texts)
    seen = spark.sparkContext.broadcast(passages.recurring(docs, key="doc_id", text="text", size=5))
    keys = passages.keyed(docs, key="doc_id", text="text", size=5, least=50, percent=80, tables=12, seen=seen).collect()
    assert {r["_id"] for r in keys} == {1, 2}
    assert all(300 <= r["_from"] <= r["_to"] < 366 for r in keys if r["_id"] == 1) and all(0 <= r["_from"] <= r["_to"] < 66 for r in keys if r["_id"] == 2)
    places = [{r["_key"] for r in keys if r["_id"] == k} for k in (1, 2)]
    assert places[0] & places[1]


def test_passages_of_a_crowded_key(spark, monkeypatch):
    """50 documents of one key, more than meet at once: the smallest shares nothing, two families and one document between them do."""
    left, right = prose(60, 8500), prose(60, 8501)
    texts = [prose(70, 8502), *(f"{prose(9, 8600 + k)} {left if k % 2 else right}" for k in range(48)), f"{left} {prose(20, 8503)} {right}"]
    one = lambda docs, *, key, text, **_: docs.select(F.lit(1).cast("long").alias("_key"), F.col(key).alias("_id"))
    monkeypatch.setattr(passages, "keyed", one)
    links = {(r.other_id, r.doc_id) for r in passages.shared(table(spark, texts)).collect()}
    assert {(1, k) for k in range(3, 49, 2)} | {(2, k) for k in range(4, 49, 2)} | {(1, 49), (2, 49)} <= links
    assert not any((a + b) % 2 for a, b in links if b < 49) and not any(0 in x for x in links)


def test_pieces_round_trip(spark):
    texts = [*odd_texts(), "▁ lower one eighth", "\x00\x01\x7f tab\t\r\n", " lead", "trail ", "a" * 5000, "𓀀𓀁"]
    docs = table(spark, texts).withColumns({"ids": F.lit("own"), "more": F.lit(2)})
    encoded = pieces.encode(docs)
    assert encoded.columns == ["doc_id", "text", "lang", "source", "n_chars", "more", "ids"]
    rows = {r.doc_id: r for r in pieces.decode(encoded).collect()}
    assert {k: r.text for k, r in rows.items()} == dict(enumerate(texts))
    assert rows[0].ids is None and rows[1].ids == []
    again = {r.doc_id: r.ids for r in pieces.encode(docs.repartition(7)).collect()}
    assert again == {k: r.ids for k, r in rows.items()}
    assert rows[5].ids != rows[6].ids[: len(rows[5].ids)]  # another row key, another sample
    assert pieces.decode(pieces.encode(empty(spark))).count() == 0
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for k in (3, 5, 8, 11):
        assert model.decode(rows[k].ids) == texts[k]


def test_pieces_follow_the_lattice():
    """Sampled segmentations of a short word have the probabilities of all its paths."""
    model = pieces.load(pieces.model_bytes(pieces.MODEL), 0.5)
    weight = {model.spelled[i]: w for i, w in zip(model.piece, model.weight) if i >= 0}

    def paths(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in weight:
                for tail, w in paths(rest[k:]):
                    yield (rest[:k], *tail), w + weight[rest[:k]]

    every = dict(paths(b" water"))
    total = sum(np.exp(w) for w in every.values())
    n = 20_000
    data = np.frombuffer(b"water" * n, np.uint8)
    ids, many = pieces.encode_rows(data, np.arange(n + 1) * 5, np.arange(n).astype(np.uint64), model)
    ends = np.cumsum(many)
    seen = {}
    for a, b in zip(ends - many, ends):
        path = tuple(model.spelled[i] for i in ids[a:b])
        seen[path] = seen.get(path, 0) + 1
    assert set(seen) <= set(every)
    for path, w in every.items():
        p = np.exp(w) / total
        assert abs(seen.get(path, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_quality_held_out_accuracy(spark):
    texts, marks = [], []
    for k in range(300):
        good = k % 4 > 0
        words = prose(60, 500 + k)
        texts.append(words if good else " ".join(f"{w}{RNG.choice(['***', '&&&', '!!'])}" for w in words.split()))
        marks.append((k, int(good), None if k % 7 else 1))
    texts += [None, "", prose(20_000, 6)]
    docs = table(spark, texts).withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([*marks, (None, 1, 1), (1, None, 1), (9999, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, learn=remainder("doc_id") != 0)
    rows = quality.score(docs, model).select("doc_id", "score", (remainder("doc_id") == 0).alias("held")).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    held = [(r.score >= 0.5, r.doc_id % 4 > 0) for r in rows if r.held and r.doc_id < 300]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.95 * len(held)
    unknown = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, unknown).collect()} == {0.5}
    assert quality.score(empty(spark), model).count() == 0


def test_licenses(spark):
    texts = [
        *odd_texts(),
        "Released under the MIT License. mit-license",
        "APACHE\nLICENSE general public license",
        prose(30, 60) + " Licensed under CC BY-NC 4.0. " + prose(10, 61),
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "gnu lesser general public license",
        "public license general",
    ]
    docs = table(spark, texts).withColumns({"labels": F.lit("own"), "n_base": F.lit(1)})
    found = licenses.scan(docs)
    assert found.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    n = len(odd_texts())
    rows = {r.doc_id: r for r in found.collect()}
    for key, text in enumerate(texts):
        r = rows[key]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) == brute.licences(text)
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert rows[n].labels == ["mit"] and rows[n + 2].labels == ["cc-by-nc"] and rows[n + 3].labels == ["bsd"] and "lgpl" in rows[n + 4].labels
    assert rows[n + 5].labels == [] and rows[5].labels == [] and rows[0].score == 0
    assert licenses.scan(empty(spark)).count() == 0


def pii_texts():
    rng = random.Random(3)
    card = lambda: next(c for c in iter(lambda: str(rng.randrange(4 * 10**15, 5 * 10**15)), None) if brute.luhn(c))
    texts = [None, "", prose(50, 70), "a" * 20_000 + "@", "1" * 20_000, "+1" + "(" * 5000, prose(30_000, 71)]
    texts += ["é ü 日本 x.y@mail.example.com_z@b.c.d, 1.2.3.4.5.6.7.8 300.1.1.1 007.0.0.255", "+1 (555) 123-4567 +12 3 and +1", "4111 1111 1111 1111-4111111111111111"]
    for k in range(60):
        texts.append(f"{prose(4, k)} mail {k}@host{k}.example.com from {k}.{k}.7.{k} pay {card()} call +1 (555) 555-{1000 + k} {prose(3, k)}")
        texts.append(f"{prose(4, k)} {card()} {card()} {prose(2, k)} 12.5 and 1999-2001")
    return texts


def test_pii(spark):
    texts = pii_texts()
    docs = table(spark, texts).withColumns({"email": F.lit("own"), "spans": F.lit(1)})
    rows = {r.doc_id: r for r in pii.redactions(docs).collect()}
    assert len(rows) == len(texts)
    added = 0
    for key, text in enumerate(texts):
        r = rows[key]
        base = [(k, s.start, s.end) for k in pii.KINDS for s in r[k]]
        assert base == brute.spans(text), key
        every = [(s.kind, s.start, s.end) for s in r.spans]
        assert set(base) <= set(every) and every == sorted(every, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))
        added += len(every) - len(base)
    assert added > 0  # card numbers that stand side by side
    assert not rows[2].spans and not rows[6].spans
    assert pii.redactions(empty(spark)).count() == 0
    out = {r.doc_id: r.text for r in pii.redact(docs, key="doc_id").collect()}
    assert out[0] is None and out[2] == texts[2] and "[email]" in out[10] and "@" not in out[10]


def test_pii_phones_of_single_digits(spark):
    """Base phones count whether or not two digits stand side by side in the text."""
    texts = ["call +1 2 3 4 5 6 7 8 9 now", "+4-4-2-0-7-9-4-6-0", "+1 (2) 3.4-5 6 7 8 9", "1 2 3", "1+", prose(20, 80)]
    rows = {r.doc_id: r for r in pii.redactions(table(spark, texts)).collect()}
    for key, text in enumerate(texts):
        assert [(k, s.start, s.end) for k in pii.KINDS for s in rows[key][k]] == brute.spans(text), key
    assert [len(rows[k].phone) for k in range(6)] == [1, 1, 1, 0, 0, 0]


def test_boosting_learns_an_interaction():
    counts = {p: ((0.0, 50.0) if (p & 1) and (p & 4) else (50.0, 0.0)) for p in range(16)}
    model = pii.boost(counts)
    assert all((pii.margin_of(model, p) > 0) == bool((p & 1) and (p & 4)) for p in counts)
