"""Read, fragment and pileup level jobs. All decoding is row-local column algebra on the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variascope import schemas
from variascope.functions import tails
from variascope.functions.bases import half_up
from variascope.plans.lineage import stored
from variascope.sources.text import base_name, numbered_lines

# Order of the eight count fields.
LETTERS = "ATCGatcg"
# Fixed value: 3' adapter of the library preparation.
ADAPTER = "CTGTCTCTTAT"
#: Bases whose prefix sums are held at once, about 60 bytes each.
BASES_AT_ONCE = 1 << 18


def parse_fastq(lines: DataFrame) -> DataFrame:
    """(file, record, id, seq, qual) from (file, line_no, value): lines of a record meet on (file, line_no div 4)."""
    part = F.col("line_no") % 4

    def pick(i: int) -> Column:
        return F.max(F.when(part == i, F.col("value")))

    return lines.groupBy("file", F.floor(F.col("line_no") / 4).alias("record")).agg(
        F.regexp_replace(pick(0), "^@", "").alias("id"), pick(1).alias("seq"), pick(3).alias("qual")
    )


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    return parse_fastq(numbered_lines(spark, path))


def reads_as_fasta(reads: DataFrame) -> DataFrame:
    return reads.select("file", "record", F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value"))


def count_reads(lines: DataFrame) -> DataFrame:
    """Reads per file from the number of lines."""
    return lines.groupBy("file").agg((F.count(F.lit(1)) / 4).cast("long").alias("n_reads"))


def cut_adapter(seq: Column, qual: Column, adapter: str = ADAPTER) -> tuple[Column, Column]:
    at = F.instr(seq, adapter)
    keep = F.when(at > 0, at - 1).otherwise(F.length(seq)).cast("int")
    return F.substring(seq, F.lit(1), keep), F.substring(qual, F.lit(1), keep)


def read_ends(raw: list[bytes], min_quality: int, offset: int) -> np.ndarray:
    """Lengths to keep of reads, all at once: ``row`` is the read of a base, ``at`` its place in the read."""
    n = np.array([len(q) for q in raw], dtype=np.int64)
    score = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64) - offset
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(score)) - np.repeat(np.cumsum(n) - n, n)
    width = np.where(n < 10, n, n // 10)
    sums = np.concatenate(([0], np.cumsum(score)))
    whole = at + width[row] <= n[row]
    ends = np.minimum(np.arange(len(score)) + width[row], len(score))
    bad = whole & (sums[ends] - sums[:-1] < min_quality * width[row])
    begin, end = n - width, n.copy()
    np.minimum.at(begin, row[bad], at[bad])
    low = (at >= begin[row]) & (at < (begin + width)[row]) & (score < min_quality)
    np.minimum.at(end, row[low], at[low])
    return end


def quality_end(qual: Column, *, min_quality: int = 20, offset: int = 33, bases: int = BASES_AT_ONCE) -> Column:
    """Length to keep from the 5' end: windows of a tenth of the read slide until one averages below the limit (or is
    the last); the read ends at the first low base of that window. Linear in the read through prefix sums, which are made
    for ``bases`` bases at once (or one longer read), whatever the reads of a batch add up to."""

    @F.pandas_udf("int")
    def run(quals: pd.Series) -> pd.Series:
        out, raw, held = [np.zeros(0, np.int64)], [], 0
        for q in quals:
            one = (q or "").encode("latin-1")
            if raw and held + len(one) > bases:
                out.append(read_ends(raw, min_quality, offset))
                raw, held = [], 0
            raw.append(one)
            held += len(one)
        if raw:
            out.append(read_ends(raw, min_quality, offset))
        return pd.Series(np.concatenate(out), dtype="int32")

    return run(qual)


def trim_reads(
    reads: DataFrame, *, min_quality: int = 20, min_length: int = 50, adapter: str = ADAPTER, truncate_n: bool = False
) -> DataFrame:
    """Adapter cut, quality trim, N rule (discard, or truncate at the first N) and minimum length."""
    seq, qual = cut_adapter(F.col("seq"), F.col("qual"), adapter)
    rows = reads.withColumn("_s", seq).withColumn("_q", qual)
    rows = rows.withColumn("_e", quality_end(F.col("_q"), min_quality=min_quality).cast("int"))
    rows = rows.withColumn("_s", F.substring(F.col("_s"), F.lit(1), F.col("_e"))).withColumn("_q", F.substring(F.col("_q"), F.lit(1), F.col("_e")))
    at = F.instr("_s", "N")
    if truncate_n:
        keep = F.when(at > 0, at - 1).otherwise(F.length("_s")).cast("int")
        rows = rows.withColumn("_q", F.substring(F.col("_q"), F.lit(1), keep)).withColumn("_s", F.substring(F.col("_s"), F.lit(1), keep))
    else:
        rows = rows.where(at == 0)
    return rows.where(F.length("_s") >= min_length).select(
        *[c for c in reads.columns if c not in ("seq", "qual")], F.col("_s").alias("seq"), F.col("_q").alias("qual")
    )


def keep_pairs(first: DataFrame, second: DataFrame, *, keys=("sample", "record")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first of pairs, second of pairs, reads whose mate was dropped). The reads of both sides are made once and stored with
    a mark for a mate; the three results are parts of that table. A read with a missing key has no mate."""
    keys = list(keys)
    both = first.withColumn("_side", F.lit(1)).unionByName(second.withColumn("_side", F.lit(2)))
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    one = Window.partitionBy(*keys)
    rows = stored(both.withColumn("_mate", known & (F.min("_side").over(one) != F.max("_side").over(one))))

    def part(which: Column) -> DataFrame:
        return rows.where(which).drop("_side", "_mate")

    mate = F.col("_mate")
    return part(mate & (F.col("_side") == 1)), part(mate & (F.col("_side") == 2)), part(~mate)


def dedup_fragments(alignments: DataFrame) -> DataFrame:
    """Best fragment (largest base-quality sum, then name) per coordinates. A maximum, so copies combine before the
    shuffle even when one fragment has very many duplicates."""
    keys = ["sample", "ref", "start", "mate_start", "strand"]
    rest = [c for c in alignments.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.col("sum_bq")).alias("q"), F.col("name")))
    return alignments.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def duplicate_rate(alignments: DataFrame) -> DataFrame:
    per = alignments.groupBy("sample", "ref", "start", "mate_start", "strand").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("sample", "ref").agg(
        F.sum("n").alias("fragments"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates")
    ).withColumn("rate", F.col("duplicates") / F.col("fragments") * 100)


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    """Pileup text of many samples; the sample is the file name up to the first dot, positions become 0-based."""
    rows = spark.read.schema(schemas.PILEUP).csv(path, sep="\t", quote="", escape="", mode="FAILFAST")
    return rows.select(
        F.regexp_extract(base_name(F.col("_metadata.file_path")), "^([^.]+)", 1).alias("sample"), "chrom",
        (F.col("pos") - 1).alias("p"), "ref", "depth", "bases", "bq", "mq", "tails",
    )


def decode_pileup(pileup: DataFrame) -> DataFrame:
    """Adds ``reads`` (array of base, bq, mq, tail), ``indels`` (signed sizes) and ``ends`` (reads starting or ending).

    Read starts (``^`` plus a mapping character) and ends (``$``) are removed, then the string is split at indel
    signs: each later piece begins with a number n and the n inserted or deleted bases, which are skipped. ``.`` and
    ``,`` stand for the reference on either strand; ``*`` keeps its place so that qualities stay aligned.
    """
    no_start = F.regexp_replace("bases", "(?s)\\^.", "")
    no_end = F.regexp_replace(no_start, "\\$", "")
    starts = F.size(F.regexp_extract_all(F.col("bases"), F.lit("(?s)\\^."), F.lit(0)))
    ends = F.length(no_start) - F.length(no_end)
    rows = pileup.withColumn("_t", no_end).withColumn("ends", (starts + ends).cast("int"))
    pieces = F.split("_t", "[+-](?=[0-9])")

    def tail(piece: Column, i: Column) -> Column:
        digits = F.regexp_extract(piece, "^([0-9]+)", 1)
        return F.when(i == 0, piece).otherwise(F.substring(piece, F.length(digits) + digits.try_cast("int") + 1, F.length(piece)))

    rows = rows.withColumn("_c", F.array_join(F.transform(pieces, tail), ""))
    signs = F.regexp_extract_all(F.col("_t"), F.lit("[+-][0-9]+"), F.lit(0))
    rows = rows.withColumn("indels", F.transform(signs, lambda s: s.cast("int")))
    ref = F.upper("ref")
    letter = lambda c: F.when(c == ".", ref).when(c == ",", F.lower(ref)).otherwise(c)
    chars = F.filter(F.split("_c", ""), lambda c: c != "")
    scores = lambda col: F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    distance = F.when(F.col("tails") == "*", F.array(F.lit(0))).otherwise(F.transform(F.split("tails", ","), lambda x: x.try_cast("int")))
    zipped = F.arrays_zip(
        F.transform(chars, letter).alias("b"), scores("bq").alias("bq"), scores("mq").alias("mq"), distance.alias("td")
    )
    return rows.withColumn("reads", zipped).drop("_t", "_c")


def _of(letter: str) -> Column:
    return F.filter("reads", lambda r: r["b"] == letter)


def _sum(arr: Column, field: str) -> Column:
    return F.aggregate(arr, F.lit(0).cast("long"), lambda a, r: a + r[field].cast("long"))


def _moments(arr: Column) -> Column:
    """Sums ``s_`` and sums of squares ``q_`` of the three scores of reads, in one pass."""
    parts = [(part, field) for part in "sq" for field in ("bq", "mq", "td")]

    def add(a: Column, r: Column) -> Column:
        value = {field: r[field].cast("long") for field in ("bq", "mq", "td")}
        return F.struct(*[(a[f"{part}_{f}"] + (value[f] if part == "s" else value[f] * value[f])).alias(f"{part}_{f}") for part, f in parts])

    # a missing score makes a sum NULL, so the zeros have to be nullable
    return F.aggregate(arr, F.struct(*[F.lit(0).cast("long").alias(f"{part}_{f}") for part, f in parts]).cast("struct<" + ", ".join(f"{part}_{f}: bigint" for part, f in parts) + ">"), add)


def pileup_counts(decoded: DataFrame) -> DataFrame:
    """Counts, mean base quality, mean mapping quality and mean tail distance (half up) per base and strand."""
    out = decoded
    for i, letter in enumerate(LETTERS):
        out = out.withColumn(f"_a{i}", _of(letter))
    cols = [F.size(f"_a{i}").alias(f"n{i}") for i in range(8)]
    for field in ("bq", "mq", "td"):
        for i in range(8):
            arr = F.col(f"_a{i}")
            mean = half_up(_sum(arr, field) / F.size(arr)).cast("int")
            cols.append(F.when(F.size(arr) > 0, mean).otherwise(0).alias(f"{field}{i}"))
    keep = [c for c in decoded.columns if c not in ("bases", "bq", "mq", "tails", "depth")]
    return out.select(*keep, *cols)


def indel_neighbourhood(decoded: DataFrame, contig_lengths: DataFrame) -> DataFrame:
    """Reads supporting an indel or a deletion near each position (clipped to the contig).

    A deletion of size s counts on [p-2, p+s+3], an insertion on [p-2, p+3]. Equal events are counted before they are
    spread over positions.
    """
    events = (
        decoded.select("sample", "chrom", "p", F.explode("indels").alias("size"))
        .groupBy("sample", "chrom", "p", F.least(F.col("size"), F.lit(0)).alias("size"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hi = F.least(F.col("p") - F.col("size") + 3, F.col("len") - 1)
    spread = events.join(contig_lengths, "chrom").withColumn(
        "q", F.explode(F.sequence(F.greatest(F.col("p") - 2, F.lit(0).cast("long")), hi.cast("long")))
    )
    return spread.groupBy("sample", "chrom", F.col("q").alias("p")).agg(
        F.sum("n").alias("near_indel"), F.sum(F.when(F.col("size") < 0, F.col("n")).otherwise(0)).alias("near_deletion")
    )


def bias_statistics(decoded: DataFrame, *, min_strand: int = 20, ratio: int = 200) -> DataFrame:
    """Per site the major and minor base and the t statistics for base quality, mapping quality and both tail
    distances, with the 2 x 2 strand table. Only sites with enough reads on both strands and a real minor base.
    """
    # reads are decoded and dealt to bases once: a generator keeps the filter on their numbers above that
    out = decoded.select(
        *[c for c in decoded.columns if c != "reads"], F.explode(F.array(F.array(*[_of(x) for x in LETTERS]))).alias("_all")
    )
    sizes = [F.size(F.get("_all", F.lit(i))) for i in range(8)]
    fold = F.sort_array(
        F.array(*[F.struct((sizes[i] + sizes[i + 4]).alias("n"), F.lit(i).alias("idx")) for i in range(4)]), asc=False
    )
    forward, reverse = sum(sizes[1:4], sizes[0]), sum(sizes[5:8], sizes[4])
    rows = out.withColumn("_r", fold).where(
        (forward > min_strand) & (reverse > min_strand) & (F.col("_r")[1]["n"] * ratio > F.col("_r")[0]["n"])
    )
    rows = rows.withColumn("major", F.col("_r")[0]["idx"]).withColumn("minor", F.col("_r")[1]["idx"])
    groups = {
        "xf": F.get("_all", F.col("major")), "xr": F.get("_all", F.col("major") + 4),
        "yf": F.get("_all", F.col("minor")), "yr": F.get("_all", F.col("minor") + 4),
    }
    rows = rows.select("*", *[F.size(arr).alias(name) for name, arr in groups.items()], *[_moments(arr).alias(f"_{name}") for name, arr in groups.items()])

    def t_value(x: Sequence[str], y: Sequence[str], field: str) -> tuple[Column, Column]:
        n1, n2 = (sum((F.col(k) for k in side[1:]), F.col(side[0])) for side in (x, y))
        s1, s2, q1, q2 = (
            sum((F.col(f"_{k}.{part}_{field}") for k in side[1:]), F.col(f"_{side[0]}.{part}_{field}")) for part in "sq" for side in (x, y)
        )
        df = (n1 + n2 - 2).cast("double")
        spread = (q1 - s1 * s1 / n1) + (q2 - s2 * s2 / n2)
        var = spread / df * (1 / n1 + 1 / n2)
        ok = (n1 > 0) & (n2 > 0) & (df > 0) & (var > 0)
        return F.when(ok, (s1 / n1 - s2 / n2) / F.sqrt(var)), F.when(ok, df)

    x, y = ("xf", "xr"), ("yf", "yr")
    tests = {"bq": t_value(x, y, "bq"), "mq": t_value(x, y, "mq"), "tf": t_value(x[:1], y[:1], "td"), "tr": t_value(x[1:], y[1:], "td")}
    cols = []
    for name, (t, df) in tests.items():
        cols += [t.alias(f"t_{name}"), df.alias(f"df_{name}")]
    return rows.select("sample", "chrom", "p", "major", "minor", *cols, "xf", "yf", "xr", "yr")


def allele_bias_tests(statistics: DataFrame) -> DataFrame:
    """-log10 p of the four t tests and the strand test, rounded half up; -1 where p is 0 or undefined."""

    def level(p: Column) -> Column:
        return F.when(p > 0, half_up(-F.log10(p))).otherwise(-1).cast("int")

    # a level names its p value twice, so p values are columns of their own first
    tests = {k: F.coalesce(tails.t_two_sided(F.col(f"t_{k}"), F.col(f"df_{k}")), F.lit(0.0)) for k in ("bq", "mq", "tf", "tr")}
    tests["strand"] = tails.fisher_two_sided(*[F.col(c) for c in ("xf", "yf", "xr", "yr")])
    rows = statistics.select("sample", "chrom", "p", "major", "minor", *[p.alias(f"_{k}") for k, p in tests.items()])
    return rows.select(
        "sample", "chrom", "p", "major", "minor", *[level(F.col(f"_{k}")).alias(f"p_{k}") for k in ("strand", "bq", "mq", "tf", "tr")]
    )


def fq_per_site(variants: DataFrame) -> DataFrame:
    """Strongest (most negative) quality of the simple variants of a site, rounded half up."""
    return (
        variants.where(F.col("simple") & (F.col("fq") < 0))
        .groupBy("sample", "chrom", "pos")
        .agg(half_up(F.min("fq")).cast("int").alias("fq"))
    )


def candidate_positions(variants: DataFrame, outgroups: DataFrame, *, max_fq: float = -30, extra: DataFrame | None = None) -> DataFrame:
    """Distinct positions with a strong simple variant in any ingroup sample, plus positions added by hand."""
    good = variants.where(F.col("simple") & (F.col("fq") < max_fq)).join(outgroups.select("sample"), "sample", "left_anti").select("p")
    if extra is not None:
        good = good.unionByName(extra.select("p"))
    return good.where("p >= 0").distinct()


def positions_fixed_everywhere(variants: DataFrame, *, n_samples: Column | int) -> DataFrame:
    """Positions variant in every sample."""
    wanted = n_samples if isinstance(n_samples, Column) else F.lit(n_samples)
    return variants.groupBy("p").agg(F.countDistinct("sample").alias("n")).where(F.col("n") == wanted)
