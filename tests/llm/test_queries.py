"""Registered corpus queries against their SQL twins or brute force on the smallest tables, and the pipeline."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


@pytest.mark.parametrize("name", ["op1_warc", "op3_exact_dedup", "op4_near_dedup", "op5_decontaminate"])
def test_twin(spark, name):
    assert compare(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name]) is None


@pytest.fixture(scope="module")
def texts():
    return dict(connect(FOLDER).execute("SELECT doc_id, text FROM documents").fetchall())


def test_pii_query(spark, texts):
    import hashlib

    rows = entry.queries()["op10_pii"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = [f"{k}:{a}:{b}" for k, a, b in brute.spans(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in brute.PII]
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_license_query(spark, texts):
    for r in entry.queries()["op9_licenses"](spark, FOLDER).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licences(texts[r.doc_id])


def test_piece_query(spark, texts):
    rows = entry.queries()["op7_pieces"](spark, FOLDER).collect()
    assert len(rows) == len(texts) and all(r.lossless and r.n_tokens == len(r.ids) for r in rows)


def test_passage_query(spark, texts):
    """Every document with a verbatim passage of 51 words of another document is found."""
    places = {}
    for key, text in texts.items():
        words = brute.RUN.findall(brute.lower(text))
        for k in range(len(words) - 50):
            places.setdefault(tuple(words[k : k + 51]), set()).add(key)
    want = {key for found in places.values() if len(found) > 1 for key in found}
    rows = entry.queries()["op6_passages"](spark, FOLDER).collect()
    assert want <= {r.doc_id for r in rows} | {r.other_id for r in rows}


def test_pipeline(spark, texts):
    """Stage by stage against brute force on each stage's own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    items = connect(FOLDER).execute("SELECT item_id, text FROM benchmark").fetchall()
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        from variascope.llm.io import written

        docs = written(stage(spark, docs, FOLDER), name)
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "pieces":
            assert docs.columns == columns
        if name == "exact":
            assert after == {r[0] for r in brute.exact(before) if r[3]}
        if name == "near":
            assert after == {key for key, _, c in brute.components(before, 80) if key == c}
        if name == "decontaminate":
            assert after == {r[0] for r in brute.contamination(before, items) if not r[2]}
        if name == "pieces":
            assert {r.doc_id: r.text for r in docs.collect()} == dict(before)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_on_no_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
