"""Plans in which costly expressions stand once, and the results that go with them."""

import re

from __spark_entry__ import queries
from variascope import bindings
from variascope.operators import reads
from variascope.sources import tables, text


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_variant_lines_are_split_once(spark):
    lines = ["#CHROM\tx", "", "c\t5\t.\tA\tT\t9\tPASS\tDP=4;FQ=-30.5", "c\t5\t.\tA\tTT\t9\tPASS\tFQ=-90", "c\t5\t.\tA\tC\t9\tPASS\tDP=1", "c\t7\t.\tA\tC\t9\tPASS\tXFQ=-9;FQ2=-12"]
    rows = tables.parse_vcf(spark.createDataFrame([(f"s{i % 2}", x) for i, x in enumerate(lines)], "sample string, value string"))
    assert [(r["sample"], r["pos"], r["fq"], r["simple"]) for r in rows.orderBy("pos", "alt").collect()] == [
        ("s0", 4, None, True), ("s0", 4, -30.5, True), ("s1", 4, -90.0, False), ("s1", 6, -12.0, True),
    ]
    best = reads.fq_per_site(rows)
    assert {(r["sample"], r["pos"], r["fq"]) for r in best.collect()} == {("s0", 4, -30), ("s1", 6, -12)}
    seen = optimized(best)
    assert len(re.findall(r"(?<!\w)split\(", seen)) == 1 and seen.count("regexp_extract(") == 1


def test_reads_are_trimmed_once_for_pairs(spark):
    good, bad = ("A" * 60, "I" * 60), ("A" * 60, "+" * 60)
    sides = [[("s", 1, *good), ("s", 1, *good), ("s", 2, *bad), ("s", 3, *good), (None, 4, *good)], [("s", 1, *good), ("s", 2, *good), (None, 4, *good)]]
    first, second = (reads.trim_reads(spark.createDataFrame(x, "sample string, record long, seq string, qual string")) for x in sides)
    parts = reads.keep_pairs(first, second)
    assert [sorted(r["record"] for r in p.collect()) for p in parts] == [[1, 1], [1], [2, 3, 4, 4]]
    assert all(p.columns == ["sample", "record", "seq", "qual"] and "trim" not in optimized(p) and "EvalPython" not in optimized(p) for p in parts)


def test_sequences_are_made_once(spark):
    seqs = bindings.sequences(spark, "/root/testdata/sf0.001")
    used = seqs.where("length(seq) > 8 AND instr(seq, 'N') = 0").selectExpr("doc_id", "substr(seq, 1, length(seq) - 1) AS a", "translate(seq, 'A', 'T') AS b")
    assert optimized(used).count("regexp_replace(") == 1


def test_pileup_reads_are_dealt_once(spark):
    bases, n = "AAAA....TTTaaaa,,,,tttCg", 24
    row = ("s", "c", 5, "G", n, bases, "".join(chr(33 + 7 * i % 40) for i in range(n)), "".join(chr(33 + i) for i in range(n)), ",".join(str(i * i % 11) for i in range(n)))
    decoded = reads.decode_pileup(spark.createDataFrame([row], "sample string, chrom string, p long, ref string, depth int, bases string, bq string, mq string, tails string"))
    stats = reads.bias_statistics(decoded, min_strand=2)
    assert optimized(stats).count("filter(") <= 8 + 4 and optimized(stats).count("aggregate(") == 4  # eight bases and the characters of three texts and the pileup
    got = stats.first()

    def t(x, y):
        mean = [sum(v) / len(v) for v in (x, y)]
        spread = sum((a - m) ** 2 for v, m in zip((x, y), mean) for a in v)
        return (mean[0] - mean[1]) / (spread / (len(x) + len(y) - 2) * (1 / len(x) + 1 / len(y))) ** 0.5

    letters = [{".": "G", ",": "g"}.get(c, c) for c in bases]
    score = {"bq": [7 * i % 40 for i in range(n)], "mq": list(range(n)), "td": [i * i % 11 for i in range(n)]}
    of = lambda field, wanted: [v for v, c in zip(score[field], letters) if c in wanted]
    assert (got.major, got.minor, got.xf, got.yf, got.xr, got.yr) == (3, 0, 4, 4, 5, 4)
    want = {"bq": ("bq", "Gg", "Aa"), "mq": ("mq", "Gg", "Aa"), "tf": ("td", "G", "A"), "tr": ("td", "g", "a")}
    for name, (field, x, y) in want.items():
        assert abs(got[f"t_{name}"] - t(of(field, x), of(field, y))) < 1e-9


def test_p_values_of_bias_tests_stand_once(spark):
    fields = ", ".join(f"t_{k} double, df_{k} double" for k in ("bq", "mq", "tf", "tr"))
    rows = spark.createDataFrame([("s", "c", 1, 0, 1, *[2.5, 20.0] * 4, 9, 1, 2, 8)], f"sample string, chrom string, p long, major int, minor int, {fields}, xf int, yf int, xr int, yr int")
    out = reads.allele_bias_tests(rows.repartition(1))
    # log10 of a column, not of the expression that makes it
    assert optimized(out).count("LOG10(_") == 5
    assert out.first()[5:] == (2, 2, 2, 2, 2)


def test_indels_are_derived_once(spark):
    out = queries()["an8_annotate_indel"](spark, "/root/testdata/sf0.001")
    # indels and genes are stored tables, which annotation reads more than once
    assert "regexp_replace" not in optimized(out) and "lineitem" not in optimized(out) and "l_partkey" not in optimized(out)


def test_lines_are_numbered_without_a_shuffle(spark, tmp_path):
    for name, n in (("a", 700), ("b", 1), ("c", 300)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        lines = text.numbered_lines(spark, str(tmp_path))
        got = lines.collect()
        # only splits are counted and put in order
        assert optimized(lines).count("Window [") == 1 and "row_number" not in optimized(lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert len(got) == 1001 and all(r["value"] == f"{r['file'][-1]} {r['line_no']}" for r in got)
