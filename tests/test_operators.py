"""Operators whose result SQL does not spell, and readers on small files."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from variascope.operators import annotate, assay, calls, reads, taxa, tree
from variascope.sources import fasta, tables

from tests import scalar_tails as tails


def test_tails():
    assert tails.normal_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-9)
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert tails.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert tails.binom_ge(3, 10, 0.2) == pytest.approx(1 - sum(math.comb(10, i) * 0.2**i * 0.8 ** (10 - i) for i in range(3)))
    assert tails.poisson_ge(4, 2.5) == pytest.approx(1 - sum(math.exp(-2.5) * 2.5**i / math.factorial(i) for i in range(4)))
    assert tails.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.0349650, abs=1e-6)
    assert tails.chi2_sf(100, 2) == pytest.approx(math.exp(-50), rel=1e-9)
    assert tails.poisson_ge(1e6, 1e6) == pytest.approx(0.5, abs=1e-3) and tails.poisson_ge(1e7, 1e7) == pytest.approx(0.5, abs=1e-3)
    assert tails.binom_ge(5e5, 1e6, 0.5) == pytest.approx(0.5, abs=1e-3)
    assert tails.mann_whitney_exact(0, 3, 3) == pytest.approx(0.1)
    assert tails.mann_whitney_exact(2, 4, 5) == pytest.approx(0.063492, abs=1e-5)
    assert tails.gamma_inc(2.0, tails.gamma_quantile(0.3, 2.0, 1.0)) == pytest.approx(0.3)


def test_site_quality_equals_all_pairs(spark):
    rnd = random.Random(7)
    rows = [(p, s, rnd.choice([0, 1, 2, None]), float(rnd.randrange(60))) for p in range(30) for s in range(7)]
    df = spark.createDataFrame(rows, "p long, sample long, call int, fq double")
    for r in calls.site_quality(df).collect():
        site = [(s, c, q) for p, s, c, q in rows if p == r.p and c is not None]
        best = [min(a[2], b[2]) for a in site for b in site if a[1] != b[1]]
        assert r.mut_qual == (max(best) if best else -1.0)
        if best:
            picked = {s: (c, q) for s, c, q in site}
            (ca, qa), (cb, qb) = picked[r.sample_a], picked[r.sample_b]
            assert ca != cb and min(qa, qb) == r.mut_qual


def test_n50_with_empty_and_missing_contigs(spark):
    """An empty contig lies behind half of the bases; it divided by zero. Lengths that are missing are no contigs."""
    sizes = {"a": [5, 3, 2, 0, 0], "b": [0, 0], "c": [4, None, 4, 1], "d": [None]}
    df = spark.createDataFrame([(k, x) for k, v in sizes.items() for x in v], "assembly string, len long")
    assert {(r.assembly, r.n50, r.l50) for r in taxa.n50_l50(df).collect()} == {("a", 5, 1), ("b", 0, 1), ("c", 4, 1)}


def slow_quality_end(qual, limit=20):
    scores = [ord(c) - 33 for c in qual]
    n = len(scores)
    w = n if n < 10 else n // 10
    at = next((i for i in range(n - w + 1) if sum(scores[i : i + w]) / w < limit), n - w)
    return next((j for j in range(at, at + w) if scores[j] < limit), n)


def test_quality_trim(spark):
    rnd = random.Random(8)
    quals = ["".join(chr(33 + rnd.randrange(10, 41)) for _ in range(rnd.randrange(1, 90))) for _ in range(60)]
    df = spark.createDataFrame([(q,) for q in quals], "qual string")
    for r in df.select("qual", reads.quality_end(F.col("qual")).alias("end")).collect():
        assert r.end == slow_quality_end(r.qual)


def test_quality_trim_holds_few_bases_at_once(monkeypatch):
    """A batch of reads is trimmed in slices, an empty batch and a read longer than a slice too."""
    rnd = random.Random(9)
    quals = ["".join(chr(33 + rnd.randrange(10, 41)) for _ in range(n)) for n in (30, 0, 70, 500, 1, 99, 100, 12)] * 5
    slices = []
    whole = reads.read_ends
    monkeypatch.setattr(reads, "read_ends", lambda raw, *rest: slices.append(raw) or whole(raw, *rest))
    made = []
    monkeypatch.setattr(reads.F, "pandas_udf", lambda kind: lambda run: lambda qual: made.append(run) or qual)
    reads.quality_end("qual", bases=100)
    assert made[0](pd.Series([*quals, None])).tolist() == [*(slow_quality_end(q) if q else 0 for q in quals), 0]
    assert made[0](pd.Series([], dtype=object)).tolist() == []
    assert all(len(raw) == 1 or sum(map(len, raw)) <= 100 for raw in slices) and sum(map(len, slices)) == len(quals) + 1


def test_pileup_decoding(spark):
    row = ("s", "c", 10, "A", 7, ".^],$+12ACGTACGTACGTg-2NN*T", "IIIHG", "55555", "1,2,3,4,5")
    df = spark.createDataFrame([row], "sample string, chrom string, p long, ref string, depth int, bases string, bq string, mq string, tails string")
    got = reads.pileup_counts(reads.decode_pileup(df)).first()
    assert [got[f"n{i}"] for i in range(8)] == [1, 1, 0, 0, 1, 0, 0, 1]
    assert got.ends == 2 and list(got.indels) == [12, -2]
    assert got.bq1 == 38 and got.td7 == 3


def test_cox_equals_dense_newton(spark):
    rnd = np.random.default_rng(9)
    n = 120
    g, e = rnd.integers(0, 2, n), rnd.integers(0, 3, n)
    t = np.ceil(rnd.exponential(6 / np.exp(0.7 * g - 0.2 * e))).clip(1, 12)
    event = (rnd.random(n) < 0.8) & (t < 12)
    df = spark.createDataFrame(
        [(float(a), int(b), int(c), bool(d)) for a, b, c, d in zip(t, g, e, event)], "time double, g int, e int, event boolean"
    )
    fit = assay.cox_fit(df, covariates=("g", "e"))
    x = np.column_stack([g, e]).astype(float)
    beta = np.zeros(2)
    for _ in range(30):
        score, info = np.zeros(2), np.zeros((2, 2))
        w = np.exp(x @ beta)
        for u in np.unique(t[event]):
            risk, dead = t >= u, (t == u) & event
            d = dead.sum()
            for k in range(d):
                wt = w * risk - k / d * w * dead
                m = (wt[:, None] * x).sum(0) / wt.sum()
                score -= m
                info += (wt[:, None, None] * x[:, :, None] * x[:, None, :]).sum(0) / wt.sum() - np.outer(m, m)
            score += x[dead].sum(0)
        beta = beta + np.linalg.solve(info, score)
    assert fit["beta"] == pytest.approx(tuple(beta), abs=1e-6)
    curve = assay.cox_curve(df, fit, covariates=("g", "e"), at=[(0.0, 1.0), (1.0, 1.0)]).collect()
    assert all(0 <= r.survival <= 1 for r in curve)


def test_mann_whitney_and_stars(spark):
    rows = [("s", "a", float(v)) for v in (1, 2, 3)] + [("s", "b", float(v)) for v in (4, 5, 6)]
    df = spark.createDataFrame(rows, "st string, arm string, x double")
    r = assay.mann_whitney(df, strata=["st"], group="arm", value="x").first()
    assert (r.u, r.n1, r.n2) == (0.0, 3, 3) and r.p == pytest.approx(0.0808556, abs=1e-6) and r.stars == "n.s."


def test_indel_effects(spark):
    gene = ("c", 1, 10, 25, 1, "CDS", "ATGAAATTTGGGTAA", "MKFG*")
    genes = spark.createDataFrame([gene], "contig string, gene long, start long, end long, strand int, type string, seq string, translation string")
    indel = spark.createDataFrame([("c", 13, "AAA", "AAAA", 2), ("c", 13, "AAA", "AAATTT", 1), ("c", 100, "A", "AC", 1)], "contig string, p long, ref string, alt string, n_samples int")
    rows = {(r.p, r.alt): r for r in annotate.annotate_indel(indel, genes, on=["contig"]).collect()}
    shift = rows[13, "AAAA"]
    assert shift.frameshift == 1 and shift.changed
    longer = rows[13, "AAATTT"]
    assert longer.frameshift == 0 and longer.stop_class == "extended" and longer.stop_pos == 6
    assert rows[100, "AC"].type == "I"


def test_lineages_with_copies(spark):
    calls_rows = [(s, p, 0) for s in range(6) for p in range(10)] + [(6, p, 1) for p in range(10)] + [(7, p, 1 if p else 2) for p in range(10)]
    df = spark.createDataFrame(calls_rows, "sample long, site long, call int")
    samples = spark.createDataFrame([(s,) for s in range(9)], "sample long")
    got = {r.sample: (r.lineage, r.size) for r in tree.lineage_clusters(df, samples.where("sample < 8"), n_sites=10, cutoff=1).collect()}
    assert all(got[s] == (0, 6) for s in range(6)) and got[6] == got[7] == (6, 2)


def test_readers(spark, tmp_path):
    (tmp_path / "samples.csv").write_text("Path,Sample,ReferenceGenome,ProviderName,Subject,Outgroup\n/d,S1,rA rB,x y,P1,0\n/d,S2,rA,x,P1,1\n")
    rows = tables.explode_multi_ref(tables.read_samples(spark, str(tmp_path / "samples.csv"))).collect()
    assert {(r["sample"], r.ref) for r in rows} == {("S1", "rA"), ("S1", "rB"), ("S2", "rA")}
    (tmp_path / "bad.csv").write_text("Path,Name,ReferenceGenome,ProviderName,Subject,Outgroup\n/d,S1,rA,x,P1,0\n")
    with pytest.raises(Exception):
        tables.read_samples(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "genome.fasta").write_text(">c1 first\nACGT\nAC\n>c2\nTTT\n")
    recs = {r.contig: r.seq for r in fasta.read_fasta(spark, str(tmp_path / "genome.fasta")).collect()}
    assert recs == {"c1": "ACGTAC", "c2": "TTT"}
    (tmp_path / "a.gff3").write_text(
        "##gff-version 3\nc1\tx\tCDS\t1\t9\t.\t+\t0\tID=L1;gene=abc;product=p q\nc1\tx\tgene\t1\t9\t.\t+\t.\tID=L0\nc1\tx\tCRISPR\t12\t20\t.\t.\t.\tID=L2\n##FASTA\n>c1\nACGT\n"
    )
    feats = {r.locustag: r for r in tables.read_gff(spark, str(tmp_path / "a.gff3")).collect()}
    assert set(feats) == {"L1", "L2"} and feats["L1"].start == 0 and feats["L2"].strand is None
    (tmp_path / "x.fq").write_text("@r1\nACGT\n+\nIIII\n@r2\nGGN\n+\n@@@\n")
    assert {(r.id, r.seq, r.qual) for r in reads.read_fastq(spark, str(tmp_path / "x.fq")).collect()} == {("r1", "ACGT", "IIII"), ("r2", "GGN", "@@@")}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "20_cutoff_values.csv").write_text("f,a,1\nf,b,0.5\n")
    (tmp_path / "t" / "21_cutoff_values.csv").write_text("f,a,2\nf,c,x\n")
    got = {(r.name, r.kind, r.i) for r in tables.read_thresholds(spark, str(tmp_path / "t")).collect()}
    assert got == {("a", "int", 2), ("c", "string", None)}
    (tmp_path / "s1.pileup").write_text("c1\t5\tA\t2\t.,\t\"I\t55\t3,4\n")
    row = reads.decode_pileup(reads.read_pileup(spark, str(tmp_path / "s1.pileup"))).first()
    assert row["sample"] == "s1" and row.p == 4 and len(row.reads) == 2 and row.reads[0].bq == 1


def test_fasta_keeps_greater_signs_in_headers(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">c1 len>5 x\nACGT\nAC\n>c2\nGG\n")
    rows = {r.contig: (r.description, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert rows == {"c1": ("c1 len>5 x", "ACGTAC"), "c2": ("c2", "GG")}


def test_joint_indels_take_names_from_their_file(spark, tmp_path):
    def text(names, pos):
        cells = "\t".join("0/1:3:1,2:0,-1" for _ in names)
        return "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(names) + f"\nc\t{pos}\t.\tA\tAC\t1\tPASS\tX\tGT:DP:AD:GL\t{cells}\n"

    (tmp_path / "x.vcf").write_text(text(["a", "b"], 5))
    (tmp_path / "y.vcf").write_text(text(["q"], 9))
    rows = tables.read_joint_indel_vcf(spark, str(tmp_path)).collect()
    assert sorted((r.pos, r.sample, r.size) for r in rows) == [(4, "a", 1), (4, "b", 1), (8, "q", 1)]
