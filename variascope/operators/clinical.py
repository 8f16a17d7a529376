"""Clinical event tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400.0


def stay_bounds(events: DataFrame, endpoint: DataFrame, *, first: Sequence[str], study_end: str) -> DataFrame:
    """First day by event priority and last moment by death, early end or study end; dates count to the end of the day.

    events: patient, entry_type, date. endpoint: patient, death, early_end.
    """
    start = F.coalesce(*[F.min(F.when(F.col("entry_type") == kind, F.col("date"))) for kind in first])
    bounds = events.groupBy("patient").agg(start.alias("first_day"))
    last = F.coalesce("death", "early_end", F.lit(study_end).cast("timestamp"))
    end_of_day = F.date_trunc("day", last) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 SECOND")
    rows = bounds.join(endpoint, "patient", "left")
    return rows.select("patient", "first_day", end_of_day.alias("last_moment")).withColumn(
        "days", (F.unix_timestamp("last_moment") - F.unix_timestamp("first_day")) / DAY
    )


def intervals_to_days(tables: Sequence[DataFrame], bounds: DataFrame) -> DataFrame:
    """Union of dated interval tables with missing columns; offsets in days since the first day; duplicates removed."""
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    zero = F.unix_timestamp("first_day")
    return (
        rows.join(bounds.select("patient", "first_day"), "patient")
        .withColumn("day_start", (F.unix_timestamp("begin") - zero) / DAY)
        .withColumn("day_stop", (F.unix_timestamp(F.coalesce("stop", "begin")) - zero) / DAY)
        .drop("first_day")
        .distinct()
    )


def treatment_reshape(
    wide: DataFrame, *, ids: Sequence[str], columns: Sequence[str], classes: Mapping[str, str], fields: Sequence[str]
) -> DataFrame:
    """Wide drug columns named ``field_number`` to one row per drug entry, with class, dose text and last end.

    Values of each entry are pivoted back by field.
    """
    long = wide.unpivot(list(ids), list(columns), "key", "val").where(F.col("val").isNotNull())
    parts = long.select(
        *ids, F.regexp_extract("key", "^(.*)_(\\d+)$", 1).alias("field"), F.regexp_extract("key", "_(\\d+)$", 1).cast("int").alias("entry"), "val"
    )
    rows = parts.groupBy(*ids, "entry").pivot("field", list(fields)).agg(F.first("val"))
    table = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.lit(v))])
    return rows.withColumn("drug_class", F.try_element_at(table, F.col("drug")))


def treatment_summary(entries: DataFrame) -> DataFrame:
    """Per patient and drug: dose texts in entry order and the latest end."""
    return entries.groupBy("patient", "drug", "drug_class").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry", "dose"))), lambda s: s["dose"]), ", ").alias("doses"),
        F.max("end").alias("last_end"),
        F.count(F.lit(1)).alias("n_entries"),
    )


def isolate_counts(isolates: DataFrame, *, sources: Sequence[str]) -> DataFrame:
    """Isolates per patient, species and day, one column per source, zeros filled."""
    wide = isolates.groupBy("patient", "species", "day").pivot("source", list(sources)).count().fillna(0)
    total = sum((F.col(s) for s in sources[1:]), F.col(sources[0]))
    return wide.withColumn("total", total)


def sample_availability(lab: DataFrame, clinic: DataFrame, *, material: str, max_days: float = 90) -> DataFrame:
    """Registries joined on sample id; per patient and day the available, then earliest sample of the right material.

    lab: sample_id, available. clinic: sample_id, patient, day, material.
    """
    both = lab.join(clinic, "sample_id", "full_outer").where(
        F.col("material").rlike(material) & (F.col("day") <= max_days)
    )
    best = F.min_by(
        F.struct("sample_id", "material", F.coalesce("available", F.lit(False)).alias("available")),
        F.struct((~F.coalesce("available", F.lit(False))).alias("missing"), "sample_id"),
    )
    return both.groupBy("patient", "day").agg(best.alias("b"), F.count(F.lit(1)).alias("n")).select("patient", "day", "b.*", "n")


def availability_share(picked: DataFrame) -> DataFrame:
    return picked.groupBy("patient").agg(
        F.avg(F.when(F.col("available"), 1.0).otherwise(0.0)).alias("share"), F.count(F.lit(1)).alias("n")
    )


def detection_status(rows: DataFrame) -> DataFrame:
    """Three-way status of a species per patient and site from two detection flags."""
    return rows.groupBy("patient", "species", "site").agg(
        F.bool_or("in_microbiome").alias("m"), F.bool_or("in_infection").alias("i")
    ).withColumn("status", F.when(F.col("m") & F.col("i"), "both").when(F.col("m"), "microbiome").when(F.col("i"), "infection"))


def status_frequency(status: DataFrame, *, values: Sequence[str] = ("both", "microbiome", "infection")) -> DataFrame:
    """Share of patients per status, one column each, per species and site."""
    known = status.where(F.col("status").isNotNull())
    wide = known.groupBy("species", "site").pivot("status", list(values)).count().fillna(0)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return wide.select("species", "site", *[(F.col(v) / total).alias(v) for v in values], total.alias("n"))


def tip_metadata(tips: DataFrame, tables: Sequence[DataFrame], *, label: Column, separator: str = "_") -> DataFrame:
    """Tip labels split into isolate, day and site, then left joined with annotation tables on the isolate."""
    parts = F.split(label, separator)
    rows = tips.withColumn("isolate", parts[0]).withColumn("day", F.get(parts, F.lit(1)).try_cast("int")).withColumn("site", F.coalesce(F.get(parts, F.lit(2)), F.lit("reference")))
    for more in tables:
        rows = rows.join(more, "isolate", "left")
    return rows
