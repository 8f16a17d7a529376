"""Molecular clock tables, regression and times to the common ancestor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variascope.functions import tails
from variascope.plans.scan import numbered


def clock_table(isolates: DataFrame, *, routine_only: bool = False) -> DataFrame:
    """Days since the subject's first isolate and since admission, mutations and callable bases per isolate.

    isolates: subject, isolate, day (date), admission (date), n_mut, callable, routine.
    """
    rows = isolates.where("routine") if routine_only else isolates
    first = rows.groupBy("subject").agg(F.min("day").alias("_first"))
    return rows.join(first, "subject").select(
        "subject", "isolate",
        F.datediff("day", "_first").cast("long").alias("days_since_first"),
        F.datediff("day", "admission").cast("long").alias("days_since_admission"),
        "n_mut", "callable", (F.col("n_mut") / F.nullif(F.col("callable"), F.lit(0))).alias("rate"),
    )


def mean_rate_by_day(clock: DataFrame) -> DataFrame:
    return clock.groupBy("subject", "days_since_first").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rate").alias("mean_rate")
    )


def linear_fit(rows: DataFrame, *, x: str, y: str, by=(), year: float = 365, scale: float = 1e6, level: float = 0.95) -> DataFrame:
    """Least squares per group: slope, intercept, r2, its standard error, p value, yearly scaled rate and interval."""
    fit = rows.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
    )
    free = (F.col("n") - 2).cast("double")
    rest = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    fit = fit.withColumn("stderr", F.when((free > 0) & (F.col("_sxx") > 0), F.sqrt(rest / free / F.col("_sxx"))))
    t = F.when(F.col("stderr") > 0, F.col("slope") / F.col("stderr"))
    quantile = tails.t_quantile((1 + level) / 2, free)
    fit = fit.withColumn("p_value", tails.t_two_sided(t, free)).withColumn("_q", quantile)
    return fit.select(
        *by, "n", "slope", "intercept", "r2", "stderr", "p_value",
        (F.col("slope") * year * scale).alias("rate"),
        ((F.col("slope") - F.col("_q") * F.col("stderr")) * year * scale).alias("rate_low"),
        ((F.col("slope") + F.col("_q") * F.col("stderr")) * year * scale).alias("rate_high"),
    )


def residual_variance(rows: DataFrame, *, x: str, y: str, by=()) -> DataFrame:
    """Variance of the residuals around the fitted line per group."""
    return rows.groupBy(*by).agg(
        ((F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)) / F.regr_count(y, x)).alias("residual_variance")
    )


def gamma_band(fit: DataFrame, variance: DataFrame, days: DataFrame, *, low: float = 0.025, high: float = 0.975, by=()) -> DataFrame:
    """Gamma band around the fitted line by day: mean on the line, variance of the residuals."""
    q = tails.gamma_quantile
    rows = days.join(fit, list(by)).join(variance, list(by))
    mean = F.col("slope") * F.col("day") + F.col("intercept")
    ok = (mean > 0) & (F.col("residual_variance") > 0)
    shape = F.when(ok, mean * mean / F.col("residual_variance"))
    scale = F.when(ok, F.col("residual_variance") / mean)
    return rows.select(*by, "day", mean.alias("mean"), q(low, shape, scale).alias("low"), q(high, shape, scale).alias("high"))


def tmrca_point(
    isolates: DataFrame, *, rate: Column, min_isolates: int = 10, year: float = 365, scale: float = 1e6, level: float = 0.95
) -> DataFrame:
    """Per time point: mean mutations per base, its t interval, ancestor age and offset before admission.

    isolates: subject, time, per_base, days_in_hospital. ``rate`` is mutations per year and ``scale`` bases.
    """
    groups = isolates.groupBy("subject", "time").agg(
        F.count(F.lit(1)).alias("n"), F.avg("per_base").alias("mean"), F.stddev_samp("per_base").alias("_sd"),
        F.min("days_in_hospital").alias("days_in_hospital"),
    ).where(F.col("n") >= min_isolates)
    q = tails.t_quantile((1 + level) / 2, F.col("n") - 1)
    rows = groups.withColumn("_m", q * F.col("_sd") / F.sqrt("n"))
    factor = F.lit(year * scale) / rate
    age = F.col("mean") * factor
    return rows.select(
        "subject", "time", "n", "mean", (F.col("mean") - F.col("_m")).alias("mean_low"), (F.col("mean") + F.col("_m")).alias("mean_high"),
        age.alias("age"), ((F.col("mean") - F.col("_m")) * factor).alias("age_low"), ((F.col("mean") + F.col("_m")) * factor).alias("age_high"),
        (F.col("days_in_hospital") - age).alias("before_admission"),
    )
