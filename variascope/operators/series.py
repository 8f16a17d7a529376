"""Allele-frequency time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variascope.plans.euler import along_path


def unpivot_samples(wide: DataFrame, *, ids: Sequence[str], samples: Sequence[str]) -> DataFrame:
    """Wide site x sample table to long rows (ids, sample, call); ``?`` becomes NULL."""
    return wide.unpivot(list(ids), list(samples), "sample", "call").withColumn(
        "call", F.nullif(F.col("call"), F.lit("?"))
    )


def allele_freq(calls: DataFrame) -> DataFrame:
    """Frequency of each allele among called samples and the number of samples, per location and pooled.

    calls: mutation, allele (the one asked for), sample, time, location, call. The pooled rows (location NULL) come
    from grouping sets, in the same pass.
    """
    g = calls.groupingSets(
        [["mutation", "allele", "time", "location"], ["mutation", "allele", "time"]], "mutation", "allele", "time", "location"
    ).agg(
        F.count_if(F.col("call") == F.col("allele")).alias("hits"), F.count("call").alias("called"), F.count(F.lit(1)).alias("n")
    )
    freq = F.when(F.col("called") > 0, F.col("hits") / F.col("called")).otherwise(F.lit(0.0))
    return g.select("mutation", "allele", "time", "location", freq.alias("freq"), "n")


def freq_shift(freqs: DataFrame, carriers: DataFrame, *, min_isolates: int = 2, min_shift: float = 0.3) -> DataFrame:
    """Mutations whose frequency moves by at least ``min_shift`` over usable time points; singletons excluded.

    freqs: mutation, allele, time, freq, n (pooled). carriers: mutation, call, n (samples per call, called only).
    """
    usable = freqs.where(F.col("n") >= min_isolates)
    shift = usable.groupBy("mutation", "allele").agg(
        (F.max("freq") - F.min("freq")).alias("s"), F.countDistinct("time").alias("times")
    )
    best = shift.where("times > 1").groupBy("mutation").agg(F.max("s").alias("shift"))
    # Carriers of calls that do not have the largest count (calls tied for the largest are all left out).
    top = carriers.groupBy("mutation").agg(F.max("n").alias("top"))
    minor = carriers.join(top, "mutation").groupBy("mutation").agg(
        F.sum(F.when(F.col("n") != F.col("top"), F.col("n")).otherwise(0)).alias("minor")
    )
    return best.join(minor, "mutation").where((F.col("minor") != 1) & (F.col("shift") >= min_shift)).select("mutation", "shift")


def long_to_wide(freqs: DataFrame, *, times: Sequence) -> DataFrame:
    """One column per time point; rows without any value are dropped."""
    wide = freqs.groupBy("mutation", "location").pivot("time", list(times)).agg(F.first("freq", ignorenulls=True))
    names = [c for c in wide.columns if c not in ("mutation", "location")]
    return wide.where(F.coalesce(*names).isNotNull())


def explode_alleles(rows: DataFrame, *, alleles: str, labels: str) -> DataFrame:
    """One row per allele from two parallel lists."""
    pairs = F.arrays_zip(F.split(alleles, "").alias("allele"), F.split(labels, ", *").alias("label"))
    return rows.withColumn("_z", F.explode(pairs)).where(F.col("_z.allele") != "").select(
        *[c for c in rows.columns if c not in (alleles, labels)], F.col("_z.allele").alias("allele"), F.col("_z.label").alias("label")
    )


def untie_times(rows: DataFrame, *, keys: Sequence[str], time: str = "time", order: str = "sample", step: float = 0.1) -> DataFrame:
    """Repeated days of a series get 0.1, 0.2, ... added (a series and day is one small partition)."""
    w = Window.partitionBy(*keys, time).orderBy(order)
    return rows.withColumn("untied", F.col(time) + (F.row_number().over(w) - 1) * F.lit(step))


def interp_grid(knots: DataFrame, *, keys: Sequence[str], points: int, log_space: bool = False, eps: float = 1e-6) -> DataFrame:
    """Monotone cubic (PCHIP) interpolation of each series on ``points`` equally spaced times.

    The grid runs from the first knot to the last one minus 1, as the last knot is a padded day. knots: keys, t
    (double), v. Slopes and end conditions are column algebra over neighbours; every knot interval generates its own
    grid points, so nothing is joined. A series has few knots.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    whole = Window.partitionBy(*keys)
    y = F.log(F.col("v") + eps) if log_space else F.col("v")
    k = (
        knots.withColumn("y", y.cast("double"))
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("i", F.row_number().over(w))
        .withColumn("h", F.lead("t").over(w) - F.col("t"))
        .withColumn("d", (F.lead("y").over(w) - F.col("y")) / F.col("h"))
        .withColumn("h0", F.lag("h").over(w))
        .withColumn("d0", F.lag("d").over(w))
        .withColumn("h2", F.lead("h").over(w))
        .withColumn("d2", F.lead("d").over(w))
        .withColumn("hb", F.lag("h", 2).over(w))
        .withColumn("db", F.lag("d", 2).over(w))
        .withColumn("first", F.min("t").over(whole))
        .withColumn("last", F.max("t").over(whole) - 1)
    )

    def edge(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
        raw = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        return (
            F.when(F.signum(raw) != F.signum(m0), 0.0)
            .when((F.signum(m0) != F.signum(m1)) & (F.abs(raw) > 3 * F.abs(m0)), 3 * m0)
            .otherwise(raw)
        )

    w1, w2 = 2 * F.col("h") + F.col("h0"), F.col("h") + 2 * F.col("h0")
    inner = F.when(F.col("d0") * F.col("d") <= 0, 0.0).otherwise((w1 + w2) / (w1 / F.col("d0") + w2 / F.col("d")))
    slope = (
        F.when(F.col("n") == 2, F.coalesce("d", "d0"))
        .when(F.col("i") == 1, edge(F.col("h"), F.col("h2"), F.col("d"), F.col("d2")))
        .when(F.col("i") == F.col("n"), edge(F.col("h0"), F.col("hb"), F.col("d0"), F.col("db")))
        .otherwise(inner)
    )
    s = (
        k.withColumn("m", slope)
        .withColumn("y1", F.lead("y").over(w))
        .withColumn("m1", F.lead("m").over(w))
        .withColumn("dx", (F.col("last") - F.col("first")) / F.lit(points - 1))
        .where(F.col("h").isNotNull())
    )
    low = F.ceil((F.col("t") - F.col("first")) / F.col("dx") - 1e-9).cast("int")
    stop = F.ceil((F.col("t") + F.col("h") - F.col("first")) / F.col("dx") - 1e-9).cast("int") - 1
    high = F.when(F.col("i") == F.col("n") - 1, F.lit(points - 1)).otherwise(F.least(stop, F.lit(points - 1)))
    g = s.withColumn("g", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    x = F.col("first") + F.col("g") * F.col("dx")
    u = (x - F.col("t")) / F.col("h")
    value = (
        (2 * u**3 - 3 * u**2 + 1) * F.col("y") + (u**3 - 2 * u**2 + u) * F.col("h") * F.col("m")
        + (-2 * u**3 + 3 * u**2) * F.col("y1") + (u**3 - u**2) * F.col("h") * F.col("m1")
    )
    value = F.exp(value) if log_space else value
    return g.select(*keys, "g", x.alias("x"), F.greatest(value, F.lit(0.0)).alias("value"))


def nested_share(values: DataFrame, parents: DataFrame, *, root: str = "root") -> DataFrame:
    """Child frequencies scaled into their parent; the parent keeps the remainder.

    values: mutation, g, value (raw, root included). parents: mutation, parent. A child of value v takes
    v * min(1, x / kids) of a parent with share x whose children sum to ``kids``, that is min(a, b x). Such functions compose to
    one of their kind, so those on the way to the root are folded by pointer doubling, whatever the depth.
    """
    raw = values.join(parents, "mutation")
    kids = raw.groupBy("parent", "g").agg(F.sum("value").alias("kids"))
    part = F.coalesce(F.col("value") / F.nullif(F.col("kids"), F.lit(0.0)), F.lit(0.0))
    rows = raw.join(kids, ["parent", "g"]).select(
        "mutation", "g", F.when(F.col("parent") != root, F.col("parent")).alias("up"), F.struct(F.col("value").alias("a"), part.alias("b")).alias("f")
    )

    def compose(own: Column, above: Column) -> Column:
        return F.struct(F.least(own["a"], own["b"] * above["a"]).alias("a"), (own["b"] * above["b"]).alias("b"))

    whole = along_path(rows, node="mutation", up="up", values={"f": compose}, keys=["g"])
    shares = whole.select("mutation", "g", F.least("f.a", "f.b").alias("share")).unionByName(
        values.where(F.col("mutation") == root).select("mutation", "g", F.lit(1.0).alias("share"))
    )
    below = kids.select(F.col("parent").alias("mutation"), "g", "kids")
    left = F.greatest(F.col("share") - F.coalesce("kids", F.lit(0.0)), F.lit(0.0))
    return shares.join(below, ["mutation", "g"], "left").select("mutation", "g", left.alias("share"))


def fit_check(observed: DataFrame, grid: DataFrame, *, key: str = "mutation") -> DataFrame:
    """Observed values next to the grid value closest in time (ties to the earlier grid point), outer joined."""
    # The nearest grid point is one of the two around t, so only those are joined: floor and ceiling of the index.
    span = grid.groupBy(key).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.max("g").alias("_n"))
    rows = observed.join(span, key, "left")
    at = (F.col("t") - F.col("_x0")) / F.nullif((F.col("_x1") - F.col("_x0")) / F.col("_n"), F.lit(0.0))
    near = F.greatest(F.lit(0), F.least(F.ceil(F.coalesce(at, F.lit(0.0)) - 0.5).cast("int"), F.col("_n")))
    est = grid.select(key, F.col("g").alias("_g"), F.col("value").alias("est"))
    return rows.withColumn("_g", near).join(est, [key, "_g"], "left").select(
        key, "t", F.col("v").alias("obs"), "est", (F.col("v") - F.col("est")).alias("diff")
    )


def edges_table(parents: DataFrame) -> DataFrame:
    return parents.select(F.col("parent").alias("Parent"), F.col("mutation").alias("Identity"))


def population_table(shares: DataFrame, times: DataFrame) -> DataFrame:
    return shares.join(times, "g").select(F.col("mutation").alias("Identity"), F.col("x").alias("Generation"), F.col("share").alias("Population"))


def count_table(freqs: DataFrame) -> DataFrame:
    """Isolates per location and time (the same for every mutation: the first one's)."""
    return freqs.groupBy("location", "time").agg(F.min_by("n", "mutation").alias("cnts"))
