"""Plate, qPCR, resistance and survival assays; rank tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variascope.functions import tails
from variascope.plans.lineage import cut
from variascope.plans.scan import running, value_tiles


def countable_dilution(
    wide: DataFrame, *, ids: Sequence[str], dilutions: Sequence[str], offset: int = 2, highest: bool = False
) -> DataFrame:
    """Long counts: the lowest (or highest) dilution with a countable value per replicate, scaled by 10^d.

    Cells may hold text, zero or nothing. The dilution is the last digit of its column name plus ``offset``.
    """
    long = wide.unpivot(list(ids), list(dilutions), "dilution", "raw")
    value = F.expr("try_cast(raw AS DOUBLE)")
    step = F.substring(F.col("dilution"), F.length("dilution"), F.lit(1)).cast("int")
    rows = long.select(*ids, step.alias("_d"), value.alias("_v")).where((F.col("_v") > 0) & F.col("_v").isNotNull())
    pick = (F.max_by if highest else F.min_by)(F.struct("_d", "_v"), "_d")
    return rows.groupBy(*ids).agg(pick.alias("_p")).select(
        *ids, (F.col("_p._d") + offset).alias("d"), (F.floor("_p._v") * F.pow(F.lit(10.0), F.col("_p._d") + offset)).alias("value")
    )


def replicate_no(rows: DataFrame, *, strain: str = "strain", date: str = "date") -> DataFrame:
    """Running experiment number of a strain, numbered over its distinct dates (few) and joined back."""
    dates = rows.select(strain, date).distinct()
    w = Window.partitionBy(strain).orderBy(date)
    return rows.join(dates.withColumn("exp_replicate", F.row_number().over(w)), [strain, date], "left")


def relative_to_input(rows: DataFrame, *, by: Sequence[str] = ("date", "strain")) -> DataFrame:
    """Value as a percentage of the group's mean input, with and without the bacteria-only background.

    rows: by, step, arm, value.
    """
    ref = rows.groupBy(*by).agg(
        F.avg(F.when(F.col("step") == "input", F.col("value"))).alias("value_input"),
        F.avg(F.when(F.col("arm") == "bacteria_only", F.col("value"))).alias("value_background"),
    )
    return rows.join(ref, list(by), "left").withColumn(
        "rel_background", (F.col("value") - F.col("value_background")) / F.col("value_input") * 100
    ).withColumn("rel", F.col("value") / F.col("value_input") * 100)


def ratio_to_mean(rows: DataFrame, *, by: Sequence[str], value: str = "value") -> DataFrame:
    means = rows.groupBy(*by).agg(F.avg(value).alias("_m"))
    return rows.join(means, list(by)).withColumn("ratio", F.col(value) / F.col("_m")).drop("_m")


def contaminated_wells(readings: DataFrame, *, threshold: float = 0.2) -> DataFrame:
    """Negative-control wells whose density rises by more than the threshold from first to last reading."""
    rise = F.max_by("od", "t") - F.min_by("od", "t")
    return (
        readings.where("control = 'negative'").groupBy("well").agg(rise.alias("rise")).where(F.col("rise") > threshold)
    )


def blank_subtract(readings: DataFrame, contaminated: DataFrame, *, max_sd: float = 0.4) -> DataFrame:
    """Sample readings minus the mean clean blank of the same time."""
    blanks = (
        readings.where("control = 'negative'").where(F.col("sd") <= max_sd).join(contaminated.select("well"), "well", "left_anti")
        .groupBy("t").agg(F.avg("od").alias("blank"))
    )
    return readings.where(F.col("control").isNull()).join(blanks, "t", "left").withColumn("norm_od", F.col("od") - F.col("blank"))


def drop_no_growth(readings: DataFrame, *, min_rise: float = 0.4) -> DataFrame:
    """Wells with enough growth, of samples all of whose wells grew."""
    wells = readings.groupBy("sample", "well").agg((F.max("norm_od") - F.min("norm_od")).alias("_rise"))
    complete = wells.groupBy("sample").agg(F.bool_and(F.col("_rise") >= min_rise).alias("_all")).where("_all")
    return readings.join(complete.select("sample"), "sample", "left_semi")


def sliding_rate(readings: DataFrame, *, keys: Sequence[str] = ("well",), t: str = "t", od: str = "norm_od") -> DataFrame:
    """Centred 3-point mean and its change per time. A well holds a bounded number of readings."""
    w = Window.partitionBy(*keys).orderBy(t)
    near = w.rowsBetween(-1, 1)
    smooth = F.when(F.count(od).over(near) == 3, F.avg(od).over(near))
    rows = readings.withColumn("smoothed", smooth)
    return rows.withColumn("rate", (F.col("smoothed") - F.lag("smoothed").over(w)) / (F.col(t) - F.lag(t).over(w)))


def max_rate(rates: DataFrame, *, keys: Sequence[str] = ("well",)) -> DataFrame:
    """Time and size (per hour) of the largest rate of each well; ties to the earliest time."""
    best = F.min(F.struct((-F.col("rate")).alias("n"), "t"))
    return rates.where(F.col("rate").isNotNull()).groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.t").alias("t_max"), (-F.col("b.n") * 3600).alias("rate_per_hour")
    )


def align_to_max(rates: DataFrame, *, keys: Sequence[str] = ("well",), sample: str = "sample", min_points: int = 2) -> DataFrame:
    """Readings on a time axis relative to the well's largest rate (10 s steps towards zero), enough points each."""
    rel = F.col("t") - F.col("t_max")
    steps = F.when(rel >= 0, F.floor(rel / 10)).otherwise(F.ceil(rel / 10)) * 10
    rows = rates.join(max_rate(rates, keys=keys), list(keys)).withColumn("rel_time", steps.cast("double")).where(F.col("rate").isNotNull())
    enough = rows.groupBy(sample, "rel_time").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    return rows.join(enough.select(sample, "rel_time"), [sample, "rel_time"], "left_semi")


def ct_clean(wells: DataFrame, *, reference_gene: str, min_gap: float = 5, undetected: float = 40) -> DataFrame:
    """Background-corrected cycle values of replicates whose reference gene clears its no-enzyme control.

    wells: sample, rep, gene, phase, kind (sample or control), ct (NULL when undetected).
    """
    rows = wells.withColumn("ct", F.coalesce("ct", F.lit(float(undetected))))
    keys = ["sample", "rep", "gene", "phase"]
    own = rows.where("kind = 'sample'").select(*keys, F.col("ct").alias("ct_smpl"))
    ctr = rows.where("kind = 'control'").select(*keys, F.col("ct").alias("ct_ctr"))
    both = own.join(ctr, keys, "left").withColumn("ct_gap", F.col("ct_ctr") - F.col("ct_smpl"))
    clean = both.where((F.col("gene") == reference_gene) & (F.col("ct_gap") >= min_gap)).select("sample", "rep", "phase").distinct()
    signal = F.pow(F.lit(2.0), -F.col("ct_smpl")) - F.pow(F.lit(2.0), -F.col("ct_ctr"))
    return both.join(clean, ["sample", "rep", "phase"], "right").withColumn(
        "ct_corrected", F.when(signal > 0, -F.log2(signal))
    )


def fold_change(clean: DataFrame, efficiency: DataFrame, *, reference_gene: str, wildtype: Column) -> DataFrame:
    """Efficiency-corrected fold change against the wild type and the reference gene, averaged per replicate."""
    by = ["sample", "rep", "gene", "phase"]
    means = clean.groupBy(*by).agg(F.avg("ct_corrected").alias("mean_ct"))
    ref = means.where(wildtype).groupBy("gene", "phase").agg(F.avg("mean_ct").alias("ct_ref"))
    rows = clean.join(ref, ["gene", "phase"], "left").join(efficiency, "gene").withColumn(
        "delta", F.col("ct_ref") - F.col("ct_corrected")
    )
    house = rows.where(F.col("gene") == reference_gene).select(
        "sample", "rep", "phase", F.col("efficiency").alias("_e"), F.col("delta").alias("_d")
    ).distinct()
    fc = F.pow(2 * F.col("efficiency"), F.col("delta")) / F.pow(2 * F.col("_e"), F.col("_d"))
    return (
        rows.join(house, ["sample", "rep", "phase"], "left")
        .groupBy(*by)
        .agg(F.avg(fc).alias("fold_change"))
        .withColumn("log2_fc", F.log2("fold_change"))
    )


def mic_fold(mics: DataFrame, *, mutation: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Ratio of the largest inhibitory concentration with and without a mutation, per drug.

    mics: drug, mic (text, ``>`` marks a censored value, ``-`` none), genotype.
    """
    level = F.log2(F.expr("try_cast(regexp_replace(mic, '[><= ]', '') AS DOUBLE)"))
    carrier = F.col("genotype").contains(mutation)
    banned = F.lit(False)
    for other in exclude:
        banned = banned | F.col("genotype").contains(other)
    rows = mics.withColumn("_l", level).where(F.col("_l").isNotNull())
    out = rows.groupBy("drug").agg(
        F.max(F.when(~carrier & ~banned, F.col("_l"))).alias("without"), F.max(F.when(carrier, F.col("_l"))).alias("with")
    )
    return out.where(F.col("without").isNotNull() | F.col("with").isNotNull()).withColumn(
        "fold", F.pow(F.lit(2.0), F.col("with") - F.col("without"))
    )


def mic_mean(mics: DataFrame) -> DataFrame:
    level = F.log2(F.expr("try_cast(regexp_replace(mic, '[><= ]', '') AS DOUBLE)"))
    return mics.withColumn("_l", level).groupBy("drug", "genotype").agg(
        F.avg("_l").alias("mean_log2"), F.count("_l").alias("n")
    )


def interval_deaths(counts: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Deaths since the previous inspection of a vial (a vial has few inspections)."""
    w = Window.partitionBy(*keys).orderBy("time")
    return counts.withColumn("deaths", F.coalesce(F.col("dead") - F.lag("dead").over(w), F.lit(0)))


def death_table(counts: DataFrame, *, keys: Sequence[str], group: Sequence[str], excluded: DataFrame | None = None) -> DataFrame:
    """One row per individual: death at the inspection that found it, survivors censored at the group's last time.

    counts: keys (which include group), time, dead (cumulative), alive_start. ``excluded`` is a tuple anti join.
    """
    rows = counts if excluded is None else counts.join(excluded, list(excluded.columns), "left_anti")
    steps = interval_deaths(rows, keys=keys)
    dead = steps.groupBy(*group, "time").agg(F.sum("deaths").cast("int").alias("n")).withColumn("event", F.lit(True))
    last = rows.groupBy(*group).agg(F.max("time").alias("time"))
    alive = rows.join(last, [*group, "time"], "left_semi").groupBy(*group, "time").agg(
        F.sum(F.col("alive_start") - F.col("dead")).cast("int").alias("n")
    ).withColumn("event", F.lit(False))
    both = dead.unionByName(alive).where("n > 0")
    return both.select(*group, "time", "event", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("individual"))


def kaplan_meier(deaths: DataFrame, *, group: Sequence[str], tile_width: float = 1000.0) -> DataFrame:
    """Product-limit survival: events are counted per time first, then a tiled running sum of log factors."""
    per = deaths.groupBy(*group, "time").agg(F.count_if("event").alias("d"), F.count(F.lit(1)).alias("leaving"))
    total = per.groupBy(*group).agg(F.sum("leaving").alias("total"))
    tile = F.floor(F.col("time") / tile_width)
    gone = running(per, keys=group, order="time", tile=tile, values={"gone": ("sum", "leaving", False)})
    risk = gone.join(total, list(group)).withColumn("at_risk", F.col("total") - F.col("gone"))
    step = risk.withColumn("_all", (F.col("d") == F.col("at_risk")).cast("int")).withColumn(
        "_log", F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)
    )
    cum = running(
        step, keys=group, order="time", tile=tile, values={"_s": ("sum", "_log", True), "_z": ("sum", "_all", True)}
    )
    return cum.select(
        *group, "time", "d", "at_risk", F.when(F.col("_z") > 0, 0.0).otherwise(F.exp("_s")).alias("survival")
    )


def cox_fit(deaths: DataFrame, *, covariates: tuple[str, str], steps: int = 25, tolerance: float = 1e-9) -> dict:
    """Proportional hazards on two covariates (Efron ties) by Newton steps.

    Individuals are counted once per (time, covariates). Every step is one distributed aggregation per time plus a
    tiled suffix sum; only the two scores and three information terms reach the driver. Returns beta, se, z, log
    likelihood and the covariate means.
    """
    x1, x2 = covariates
    cells = cut(
        deaths.groupBy(F.col("time").cast("double").alias("time"), F.col(x1).cast("double").alias("a"), F.col(x2).cast("double").alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("event").alias("d")
        )
    )
    n, ma, mb = cells.agg(F.sum("n"), F.sum(F.col("a") * F.col("n")) / F.sum("n"), F.sum(F.col("b") * F.col("n")) / F.sum("n")).first()
    cells = cells.withColumn("a", F.col("a") - ma).withColumn("b", F.col("b") - mb)
    tiles = value_tiles(cells, "time", 16)
    beta = [0.0, 0.0]
    result = {}
    for _ in range(steps):
        result = _cox_step(cells, tiles, beta)
        (u1, u2), (i11, i12, i22) = result["score"], result["information"]
        det = i11 * i22 - i12 * i12
        if det <= 0:
            raise ValueError("the covariates do not identify the model")
        move = ((i22 * u1 - i12 * u2) / det, (i11 * u2 - i12 * u1) / det)
        result.update(beta=tuple(beta), variance=(i22 / det, i11 / det))
        beta = [beta[0] + move[0], beta[1] + move[1]]
        if max(abs(m) for m in move) < tolerance:
            break
    else:
        raise RuntimeError(f"no convergence in {steps} Newton steps")
    se = tuple(v**0.5 for v in result["variance"])
    z = tuple(b / s for b, s in zip(beta, se))
    return {
        "beta": tuple(beta), "se": se, "z": z, "p": tuple(min(1.0, 2 * tails.normal_sf(abs(v))) for v in z),
        "log_likelihood": result["log_likelihood"], "means": (ma, mb), "n": n,
    }


def _cox_step(cells: DataFrame, tiles: Column, beta: Sequence[float]) -> dict:
    risk = F.exp(F.col("a") * beta[0] + F.col("b") * beta[1])
    parts = {"w": F.lit(1.0), "a": F.col("a"), "b": F.col("b"), "aa": F.col("a") * F.col("a"), "ab": F.col("a") * F.col("b"), "bb": F.col("b") * F.col("b")}
    per = cells.groupBy("time").agg(
        F.sum("d").alias("d"),
        F.sum(F.col("d") * F.col("a")).alias("xa"),
        F.sum(F.col("d") * F.col("b")).alias("xb"),
        *[F.sum(F.col("n") * risk * v).alias(f"s_{k}") for k, v in parts.items()],
        *[F.sum(F.col("d") * risk * v).alias(f"t_{k}") for k, v in parts.items()],
    ).withColumn("neg", -F.col("time"))
    sums = running(
        per, keys=[], order="neg", tile=-tiles, values={f"r_{k}": ("sum", f"s_{k}", True) for k in parts}
    ).where("d > 0")
    # Efron: the k-th of d tied deaths leaves k/d of the tied weight out. Ties are expanded in chunks of 1000.
    chunks = sums.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("d") - 1) / 1000))))
    ties = chunks.withColumn(
        "f", F.explode(F.transform(
            F.sequence(F.col("c") * 1000, F.least(F.col("c") * 1000 + 999, F.col("d") - 1)), lambda k: k / F.col("d")
        ))
    )

    def left(k: str) -> Column:
        return F.col(f"r_{k}") - F.col("f") * F.col(f"t_{k}")

    w, a, b = left("w"), left("a"), left("b")
    tied = ties.agg(
        F.sum(a / w), F.sum(b / w), F.sum(left("aa") / w - a * a / w / w), F.sum(left("ab") / w - a * b / w / w),
        F.sum(left("bb") / w - b * b / w / w), F.sum(F.log(w)),
    ).first()
    xa, xb = per.agg(F.sum("xa"), F.sum("xb")).first()
    return {
        "score": (xa - tied[0], xb - tied[1]),
        "information": (tied[2], tied[3], tied[4]),
        "log_likelihood": beta[0] * xa + beta[1] * xb - tied[5],
    }


def cox_curve(deaths: DataFrame, fit: dict, *, covariates: tuple[str, str], at: Sequence[tuple[float, float]]) -> DataFrame:
    """Predicted survival over time for given covariate values (Breslow baseline)."""
    (b1, b2), (m1, m2) = fit["beta"], fit["means"]
    x1, x2 = covariates
    risk = F.exp((F.col(x1) - m1) * b1 + (F.col(x2) - m2) * b2)
    per = deaths.groupBy(F.col("time").cast("double").alias("time")).agg(F.count_if("event").alias("d"), F.sum(risk).alias("s")).withColumn("neg", -F.col("time"))
    tiles = value_tiles(per, "time", 16)
    risk_set = running(per, keys=[], order="neg", tile=-tiles, values={"r": ("sum", "s", True)}).withColumn("h", F.col("d") / F.col("r"))
    base = running(risk_set, keys=[], order="time", tile=tiles, values={"cum": ("sum", "h", True)})
    curves = F.array(*[
        F.struct(F.lit(float(u)).alias(x1), F.lit(float(v)).alias(x2), F.exp(-F.col("cum") * F.exp(F.lit((u - m1) * b1 + (v - m2) * b2))).alias("survival"))
        for u, v in at
    ])
    return base.select("time", F.explode(curves).alias("c")).select("time", "c.*")


def survival_share(counts: DataFrame, *, group: Sequence[str]) -> DataFrame:
    """1 - median of died over at risk at the last time, per group; equal shares are counted first."""
    last = counts.agg(F.max("time")).scalar()
    per = counts.where(F.col("time") == last).groupBy(*group, "dead", "alive_start").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*group).agg((1 - F.percentile(F.col("dead") / F.col("alive_start"), F.lit(0.5), F.col("n"))).alias("survived"))


def mann_whitney(rows: DataFrame, *, strata: Sequence[str], group: str, value: str) -> DataFrame:
    """U test for every pair of groups inside a stratum: U of the first group, two-sided p, star label.

    Values are counted per (stratum, group, value) first. For a pair, each value's rank among the two groups follows
    from both groups' counts below it, so U = sum over values of n1 * (below2 + n2 / 2). P values are
    the tie-corrected normal approximation with continuity at every size. The number of groups is small (experimental arms); rows are never paired.
    """
    strata = list(strata)
    tile = value_tiles(rows, value, 32)
    keys = [*strata, group]
    mine = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    other = sizes.select(*strata, F.col(group).alias("g2"), F.col("size").alias("n2"))
    # Every value of a stratum, seen from every group: count at the value and below it.
    values = rows.select(*strata, value).distinct()
    arms = sizes.groupBy(*strata).agg(F.collect_set(group).alias("_arms"))
    listed = values.join(arms, strata) if strata else values.withColumn("_arms", arms.select("_arms").scalar())
    grid = listed.select(*strata, value, F.explode("_arms").alias(group))
    full = grid.join(mine.select(*keys, value, "n"), [*keys, value], "left").fillna(0, ["n"])
    cum = running(full, keys=keys, order=value, tile=tile, values={"below": ("sum", "n", False)})
    left = cum.where("n > 0").select(*strata, F.col(group).alias("g1"), value, F.col("n").alias("k1"))
    right = cum.select(*strata, F.col(group).alias("g2"), value, F.col("n").alias("k2"), F.coalesce("below", F.lit(0)).alias("b2"))
    u = (
        left.join(right, [*strata, value])
        .where(F.col("g1") < F.col("g2"))
        .groupBy(*strata, "g1", "g2")
        .agg(F.sum(F.col("k1") * (F.col("b2") + F.col("k2") / 2)).alias("u"))
    )
    tied = cum.select(*strata, F.col(group).alias("g1"), value, F.col("n").alias("k1")).join(right.drop("b2"), [*strata, value]).where(
        F.col("g1") < F.col("g2")
    ).withColumn("_t", F.col("k1") + F.col("k2")).groupBy(*strata, "g1", "g2").agg(
        F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("ties")
    )
    first = sizes.select(*strata, F.col(group).alias("g1"), F.col("size").alias("n1"))
    out = u.join(tied, [*strata, "g1", "g2"]).join(first, [*strata, "g1"]).join(other, [*strata, "g2"])
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    # Continuity correction towards the mean; the upper U is at or above it, and p is capped at 1.
    shift = F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2.0) - 0.5
    z = F.when(sd > 0, F.greatest(shift, F.lit(0.0)) / sd)
    p = tails.normal_two_sided(z)
    return out.withColumn("z", z).withColumn("p", p).select(*strata, "g1", "g2", "n1", "n2", "u", "z", "p").withColumn(
        "stars", stars(F.col("p"))
    )


def stars(p: Column) -> Column:
    """Significance label of a p value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")
