"""Manifests, logs, taxonomic and annotation text tables. Every reader is a scan plus column expressions.

``parse_*`` functions work on rows that already hold lines, ``read_*`` functions add the file scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variascope import schemas
from variascope.plans.scan import numbered, running
from variascope.sources.text import base_name, numbered_lines


def read_samples(spark: SparkSession, path: str, *, schema: str = schemas.SAMPLES) -> DataFrame:
    """Sample manifest. A wrong header or a malformed row fails the read."""
    rows = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    out = rows.withColumnRenamed("Sample", "sample").withColumn("outgroup", F.coalesce(F.col("Outgroup") == 1, F.lit(False)))
    return out.withColumn("paths", F.split("Path", " ")).withColumnRenamed("ReferenceGenome", "refs")


def explode_multi_ref(samples: DataFrame, *, refs: str = "refs") -> DataFrame:
    """One row per (sample, reference) from a blank-separated list."""
    return samples.withColumn("ref", F.explode(F.split(F.trim(F.col(refs)), " +"))).drop(refs)


def group_members(rows: DataFrame, *, key: str, member: str, keep: Column | None = None) -> DataFrame:
    """Ordered member list per key (manifest-sized), optionally of a subset of rows."""
    kept = rows if keep is None else rows.where(keep)
    return kept.groupBy(key).agg(F.sort_array(F.collect_set(member)).alias("members"), F.count(F.lit(1)).alias("n"))


def parse_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FAI).csv(path, sep="\t", mode="FAILFAST")


def parse_vcf(lines: DataFrame) -> DataFrame:
    """Body rows of a variant file with the FQ value of INFO; ``simple`` marks unambiguous single-base changes.

    A line is made and split once and INFO is searched once: each goes through a generator, below which Spark does not move
    the filters on parsed columns. Moved further down they would make or split a line again for every column that they name.
    """
    rest = [c for c in lines.columns if c != "value"]
    body = lines.select(*rest, F.explode(F.array("value")).alias("value")).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.col("_f")
    rows = body.select(*rest, F.explode(F.array(F.split("value", "\t"))).alias("_f")).select(
        *rest, f[0].alias("chrom"), (f[1].cast("long") - 1).alias("pos"), f[3].alias("ref"), f[4].alias("alt"), f[7].alias("info")
    )
    found = F.regexp_extract(F.concat(F.lit(";"), F.col("info")), ";FQ[^=;]*=([^;]+)", 1)
    rows = rows.select("*", F.explode(F.array(found)).alias("_fq"))
    return rows.withColumn("fq", F.when(F.col("_fq") != "", F.col("_fq").cast("double"))).withColumn(
        "simple", (F.length("ref") == 1) & (F.length("alt") == 1)
    ).drop("_fq")


def read_vcf_fq(spark: SparkSession, path: str, *, sample: str = r"([^./]+)[^/]*$") -> DataFrame:
    """Variant files of many samples, gzipped or not; the sample is a part of the path, by default the file name up to
    its first dot."""
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.regexp_extract("_metadata.file_path", sample, 1).alias("sample"))
    return parse_vcf(lines)


def parse_joint_indel(lines: DataFrame, *, samples: Sequence[str] | None = None, outgroups: Sequence[str] = ()) -> DataFrame:
    """Joint indel rows to one row per (site, sample) with reference and best alternate depth and likelihood.

    Sample names come from ``samples`` or from the ``#CHROM`` header of the row's ``file`` (of all rows when there is no
    such column; headers that differ are an error then). FORMAT order is free. The best alternate has the largest
    likelihood, ties to the later one. Samples without likelihoods and outgroups are NULL.
    """
    f = F.split("value", "\t")
    rest = [c for c in lines.columns if c != "value"]
    body = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    header = lines.where(F.col("value").startswith("#CHROM")).select(
        *[c for c in rest if c == "file"], F.slice(f, F.lit(10), F.size(f)).alias("_names")
    ).distinct()
    if samples is not None:
        body = body.withColumn("_names", F.array(*[F.lit(s) for s in samples]))
    elif "file" in rest:
        body = body.join(header, "file")
    else:
        body = body.withColumn("_names", header.scalar())
    rows = body.select(
        "_names",
        *rest, f[0].alias("chrom"), (f[1].cast("long") - 1).alias("pos"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"),
        F.split(f[8], ":").alias("fmt"), F.posexplode(F.slice(f, F.lit(10), F.size(f))).alias("i", "cell"),
    ).withColumn("sample", F.get("_names", F.col("i")))
    parts = F.split("cell", ":")

    def field(name: str) -> Column:
        at = F.array_position("fmt", name).cast("int")
        return F.when(at > 0, F.get(parts, at - 1))

    gl = F.transform(F.split(field("GL"), ","), lambda x: x.try_cast("double"))
    ad = F.transform(F.split(field("AD"), ","), lambda x: x.try_cast("int"))
    known = field("GL").isNotNull() & (field("GL") != ".") & ~F.coalesce(F.col("sample").isin(list(outgroups)), F.lit(False))
    rows = rows.withColumn("gl", F.when(known, gl)).withColumn("ad", F.when(known, ad)).withColumn("dp", F.when(known, field("DP").try_cast("int")))
    best = F.array_max(F.transform(F.slice("gl", F.lit(2), F.size("alts")), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("_b", best)
    alt = F.get("alts", F.col("_b.i"))
    return rows.select(
        *rest, "chrom", "pos", "sample", F.when(F.col("_b").isNotNull(), F.col("ref")).alias("ref"), alt.alias("alt"),
        F.get("ad", F.lit(0)).alias("dp_ref"), F.get("ad", F.col("_b.i") + 1).alias("dp_alt"), "dp",
        F.get("gl", F.lit(0)).alias("gl_ref"), F.col("_b.g").alias("gl_alt"), (F.length(alt) - F.length("ref")).alias("size"),
    )


def read_joint_indel_vcf(spark: SparkSession, path: str, **options) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_joint_indel(lines, **options).drop("file")


# Feature types without annotation of their own.
EXCLUDED_TYPES = ("gene", "region", "gap")


def parse_gff(lines: DataFrame, *, fasta_line: Column | None = None, order: str = "line_no") -> DataFrame:
    """Annotation features with attributes as a map and the usual ones as columns.

    ``fasta_line`` is the number of the ``##FASTA`` line of the row's file; rows from there on are sequence.
    """
    rows = lines if fasta_line is None else lines.where(fasta_line.isNull() | (F.col(order) < fasta_line))
    f = F.split("value", "\t")
    rest = [c for c in lines.columns if c != "value"]
    body = rows.where(~F.col("value").startswith("#") & (F.size(f) == 9))
    feats = body.select(
        *rest, f[0].alias("contig"), f[2].alias("type"), (f[3].cast("long") - 1).alias("start"), f[4].cast("long").alias("end"),
        F.when(f[6] == "+", 1).when(f[6] == "-", -1).alias("strand"), f[7].try_cast("int").alias("codon_start"),
        F.str_to_map(F.regexp_replace(f[8], ";+$", ""), F.lit(";"), F.lit("=")).alias("attributes"),
    ).where(~F.col("type").isin(*EXCLUDED_TYPES))

    def attr(*names: str) -> Column:
        return F.coalesce(*[F.replace(F.try_element_at("attributes", F.lit(n)), F.lit(","), F.lit(";")) for n in names], F.lit("."))

    return feats.select(
        *feats.columns, attr("ID").alias("locustag"), attr("gene").alias("gene"), attr("product").alias("product"),
        attr("protein_id").alias("protein_id"), attr("Dbxref").alias("db_xref"), attr("note", "Note").alias("note"),
    )


def number_features(features: DataFrame, *, order: Sequence[Column], tile: Column) -> DataFrame:
    """``tagnumber`` counts all features in order and is 0 for those that are not coding."""
    rows = numbered(features, keys=[], order=order, tile=tile, name="_n")
    return rows.withColumn("tagnumber", F.when(F.col("type").isin("CDS", "gene"), F.col("_n")).otherwise(F.lit(0))).drop("_n")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path)
    cut = lines.where(F.col("value").startswith("##FASTA")).groupBy("file").agg(F.min("line_no").alias("_fasta"))
    return parse_gff(lines.join(cut, "file", "left"), fasta_line=F.col("_fasta")).drop("_fasta")


def parse_tax_report(lines: DataFrame, *, ranks: Sequence[str] = ("S", "G", "F", "O", "C", "P", "D")) -> DataFrame:
    """Report lines (percent, reads, own reads, rank, taxon id, indented name) of the wanted ranks in one pass."""
    f = F.split(F.trim(F.col("value")), "\\s+", 6)
    rest = [c for c in lines.columns if c != "value"]
    return lines.select(
        *rest, f[0].cast("double").alias("pct"), f[1].cast("long").alias("reads"), f[3].alias("rank"), f[4].cast("long").alias("taxid"),
        F.regexp_replace(F.trim(f[5]), "\\s+", "_").alias("taxon"),
    ).where(F.col("rank").isin(*ranks))


def read_tax_report(spark: SparkSession, path: str, *, sample: str = r"([^/]+)_krakenRep_bracken\.txt$") -> DataFrame:
    """Reports of many samples; the sample is a part of the path, by default the file name without its suffix."""
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.regexp_extract("_metadata.file_path", sample, 1).alias("sample"))
    return parse_tax_report(lines)


# Fields of the lineage dump, in order.
LINEAGE_FIELDS = ("taxid", "name", "species", "genus", "family", "order", "class", "phylum", "kingdom", "domain")


def parse_ranked_lineage(lines: DataFrame, references: DataFrame) -> DataFrame:
    """Species rows of the lineage dump whose name contains, and is contained in, a reference's species name.

    Containment both ways means equality, so this is a plain equi-join on the name. references: ref, species_name.
    """
    f = F.split(F.replace(F.col("value"), F.lit("\t"), F.lit("")), "\\|")
    rows = lines.select(*[F.trim(f[i]).alias(n) for i, n in enumerate(LINEAGE_FIELDS)])
    species = rows.where((F.col("species") == "") & (F.col("genus") != "")).drop("species", "taxid")
    return references.join(species.withColumnRenamed("name", "species"), F.col("species_name") == F.col("species")).drop("species_name")


def read_ranked_lineage(spark: SparkSession, path: str, references: DataFrame) -> DataFrame:
    return parse_ranked_lineage(spark.read.text(path), references)


def species_of_header(header: Column) -> Column:
    """Genus and species from the first header line of a reference sequence."""
    parts = F.split(header, " ")
    return F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))


def _sample_ref(name: Column) -> tuple[Column, Column]:
    return (
        F.regexp_replace(name, "_ref_.*", "").alias("sample"),
        F.regexp_replace(F.regexp_replace(name, "_aligned.*", ""), ".*_ref_", "").alias("ref"),
    )


def parse_map_log(logs: DataFrame) -> DataFrame:
    """Mapping percentages from whole aligner logs (name, value). A missing line gives NULL."""
    rate = lambda word: F.regexp_extract("value", f"(?m)^[^\\n]*?([0-9.]+)%[^\\n]*{word}", 1).try_cast("double")
    return logs.select(*_sample_ref(F.col("name")), rate("overall").alias("overall_rate"), rate("exactly").alias("once_rate"))


def parse_dedup_log(logs: DataFrame) -> DataFrame:
    """Pairs, duplicates and optical duplicates from the line after the metrics header of whole logs."""
    row = F.split(F.regexp_extract("value", "UNPAIRED_READS_EXAMINED[^\\n]*\\n([^\\n]*)", 1), "\t")
    return logs.select(
        *_sample_ref(F.col("name")), F.get(row, F.lit(2)).try_cast("long").alias("pairs"),
        F.get(row, F.lit(6)).try_cast("long").alias("pair_dups"), F.get(row, F.lit(7)).try_cast("long").alias("optical_dups"),
    )


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", base_name(F.col("_metadata.file_path")).alias("name"))


def read_map_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_map_log(_whole(spark, path))


def read_dedup_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_dedup_log(_whole(spark, path))


def parse_clusters(lines: DataFrame, *, tile: int = 100_000) -> DataFrame:
    """Member rows (cluster, tag, gene) of cluster files; the cluster number is the running count of header lines."""
    marked = lines.withColumn("_h", F.col("value").startswith(">").cast("int"))
    placed = running(
        marked, keys=["file"], order="line_no", tile=F.floor(F.col("line_no") / tile), values={"cluster": ("sum", "_h", True)}
    )
    gene = F.regexp_extract("value", ">([^.\\s]+)", 1)
    return placed.where("_h = 0").select(
        "file", F.col("cluster").cast("long").alias("cluster"), F.get(F.split(gene, "_"), F.lit(0)).alias("tag"), gene.alias("gene")
    ).where(F.col("gene") != "")


def cluster_table(members: DataFrame, *, tags: Sequence[str], keys: Sequence[str] = ("cluster",)) -> DataFrame:
    """One row per cluster, one column per genome tag, several genes of a genome joined by comma, NA when absent.

    Clusters of several files are told apart by ``keys`` = file and cluster.
    """
    wide = members.groupBy(*keys).pivot("tag", list(tags)).agg(F.array_join(F.array_sort(F.collect_list("gene")), ","))
    return wide.select(*keys, *[F.coalesce(F.nullif(F.col(t), F.lit("")), F.lit("NA")).alias(t) for t in tags])


def read_cluster_file(spark: SparkSession, path: str, *, tile: int = 100_000) -> DataFrame:
    return parse_clusters(numbered_lines(spark, path), tile=tile)


# Report lines that repeat what is computed from the contigs, or that are headings.
STATS_SKIP = "Length:|Count:|N50:|^Sequence\\(s\\):$|^Annotation:$"


def parse_assembly_stats(reports: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """``key: value`` report text per assembly to one row, up to the tool's own section."""
    body = F.element_at(F.split("value", "(?m)^Bakta:"), 1)
    lines = reports.select("assembly", F.explode(F.split(body, "\\r?\\n")).alias("line"))
    pairs = lines.where(F.col("line").contains(": ") & ~F.trim("line").rlike(STATS_SKIP)).select(
        "assembly", F.replace(F.trim(F.get(F.split("line", ": "), F.lit(0))), F.lit(" "), F.lit("_")).alias("k"), F.get(F.split("line", ": "), F.lit(1)).alias("v")
    )
    return pairs.groupBy("assembly").pivot("k", list(keys)).agg(F.first("v"))


def contig_header_stats(headers: DataFrame, *, header: str = "header") -> DataFrame:
    """Length and coverage from contig names of the form ``NODE_1_length_500_cov_3.2``."""
    parts = F.split(header, "_")
    return headers.withColumn("len", F.get(parts, F.lit(3)).try_cast("long")).withColumn("cov", F.get(parts, F.lit(5)).try_cast("double"))


def parse_plate(rows: DataFrame, *, label: str, values: Sequence[str], tile: int = 100_000) -> DataFrame:
    """Stacked well blocks to (file, well, measure, cycle, value).

    A blank label starts a new block; the first labelled row of a block is its well. Rows: file, line_no, label, values.
    """
    blank = F.coalesce(F.trim(F.col(label)), F.lit("")) == ""
    marked = rows.withColumn("_b", blank.cast("int"))
    t = F.floor(F.col("line_no") / tile)
    blocks = running(marked, keys=["file"], order="line_no", tile=t, values={"block": ("sum", "_b", True)}).where(
        (F.col("_b") == 0) & (F.col(label) != "Cycles / Well")
    )
    first = blocks.groupBy("file", "block").agg(F.min(F.struct("line_no", F.col(label).alias("w"))).alias("_f"))
    well = F.concat(F.substring(F.col("_f.w"), F.lit(1), F.lit(1)), F.lpad(F.substring(F.col("_f.w"), F.lit(2), F.length("_f.w")), 2, "0"))
    data = blocks.join(first, ["file", "block"]).where(F.col("line_no") > F.col("_f.line_no")).select(
        "file", well.alias("well"), F.col(label).alias("measure"), *values
    )
    return data.unpivot(["file", "well", "measure"], list(values), "cycle", "value")


def plate_wide(long: DataFrame, *, measures: Sequence[str]) -> DataFrame:
    """One row per well and cycle with a column per measure."""
    return long.groupBy("file", "well", "cycle").pivot("measure", list(measures)).agg(F.first("value"))


def parse_layout(rows: DataFrame, *, columns: Sequence[str]) -> DataFrame:
    """Plate layout blocks (descriptor, row letter, one column per plate column) to (well, descriptor, value)."""
    long = rows.unpivot(["descriptor", "row"], list(columns), "col", "value").where(F.col("value").isNotNull())
    return long.select(F.concat("row", F.lpad(F.col("col"), 2, "0")).alias("well"), "descriptor", "value")


def typed_value(text: Column) -> Column:
    """(kind, int, double, text): the first type of int, double, text that fits."""
    as_int, as_double = text.try_cast("long"), text.try_cast("double")
    kind = F.when(as_int.isNotNull(), "int").when(as_double.isNotNull(), "double").otherwise("string")
    return F.struct(kind.alias("kind"), as_int.alias("i"), F.coalesce(as_double, as_int.cast("double")).alias("d"), text.alias("s"))


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Three-column threshold file (group, name, value); of several files the last by name is used."""
    rows = spark.read.schema("grp string, name string, value string").csv(path).withColumn("file", F.col("_metadata.file_path"))
    newest = rows.agg(F.max("file")).scalar()
    return rows.where(F.col("file") == newest).select("grp", "name", typed_value(F.trim("value")).alias("v")).select("grp", "name", "v.*")


def read_cmt(spark: SparkSession, path: str, name: str, ref: str | None = None) -> DataFrame:
    """One table of a stored candidate set; ``ref`` prunes to one reference's partition."""
    rows = spark.read.parquet(f"{path}/{name}")
    return rows if ref is None else rows.where(F.col("ref") == ref)
