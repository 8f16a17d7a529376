"""Column forms of the tails against plain numbers, far tails and odd arguments included."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tests import scalar_tails as plain
from variascope.functions import tails

SIZES = [0.3, 0.5, 1, 1.5, 2, 5, 50, 333, 1e4, 1e6]
CASES = {
    "lgamma": (math.lgamma, [(v,) for v in SIZES], 1e-13),
    "beta_inc": (plain.beta_inc, list(itertools.product(SIZES, SIZES, [0, 1e-6, 0.01, 0.3, 0.5, 0.77, 0.99, 0.999999, 1])), 1e-7),
    "gamma_inc": (plain.gamma_inc, [(a, a * f) for a in SIZES for f in (0, 0.01, 0.5, 0.99, 1, 1.1, 2, 10)], 1e-9),
    "gamma_upper": (plain.gamma_upper, [(a, a * f) for a in SIZES for f in (0.01, 0.5, 0.99, 1, 1.1, 2, 10)], 1e-9),
    "binom_ge": (plain.binom_ge, [(k, n, p) for n in (1, 5, 100, 1e6) for k in (-1, 0, 1, n // 10, n // 2, n, n + 1) for p in (1e-6, 0.1, 0.5, 0.9)], 1e-8),
    "poisson_ge": (plain.poisson_ge, [(k, r) for k in (0, 1, 5, 1000, 1e6) for r in (0.1, 5, 900, 1e6)], 1e-8),
    "chi2_sf": (plain.chi2_sf, [(x, df) for x in (0.1, 1, 10, 300) for df in (1, 2, 7, 200)], 1e-9),
    "normal_two_sided": (lambda z: 2 * plain.normal_sf(abs(z)), [(z,) for z in (0, 0.1, -1.96, 3, 8, 20)], 1e-9),
    "t_two_sided": (plain.t_two_sided, [(t, df) for t in (0, 0.1, -2, 5, 30) for df in (1, 2, 3, 10, 1e6)], 1e-8),
    "t_quantile": (plain.t_quantile, [(q, df) for q in (0.5, 0.6, 0.975, 0.9999995) for df in (1, 2, 3, 10, 1e6)], 1e-7),
    "gamma_quantile": (plain.gamma_quantile, [(q, s, c) for q in (0.025, 0.3, 0.975) for s in (0.3, 1, 4, 1e4) for c in (0.5, 3)], 1e-9),
    "fisher_two_sided": (
        lambda *t: plain.fisher_two_sided(*map(int, t)),
        [*itertools.product([0, 1, 8, 40], [0, 2, 30], [0, 1, 50], [0, 5, 20]), (500, 100, 80, 700), (5000, 5000, 5000, 5100)], 1e-8,
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_columns_equal_plain_numbers(spark, name):
    fn, rows, rel = CASES[name]
    names = list("abcd")[: len(rows[0])]
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in rows], names)
    for r in df.select(*names, getattr(tails, name)(*[F.col(c) for c in names]).alias("v")).collect():
        assert r.v == pytest.approx(fn(*r[:-1]), rel=rel, abs=1e-13), tuple(r)


def test_null_and_nan_give_null(spark):
    values = spark.createDataFrame([(0.5, None, math.nan)], "good double, missing double, nan double")
    cols = []
    for name in [n for n in CASES if n != "lgamma"]:
        for bad, at in (("missing", 0), ("nan", len(CASES[name][1][0]) - 1)):
            args = ["good"] * len(CASES[name][1][0])
            args[at] = bad
            cols.append(getattr(tails, name)(*[F.col(c) for c in args]).alias(f"{name}_{bad}_{at}"))
    for part in range(0, len(cols), 12):
        assert set(values.select(*cols[part : part + 12]).first()) == {None}


def test_no_python_in_the_plan(spark):
    df = spark.range(5).select(tails.binom_ge(F.col("id"), F.lit(10), F.lit(0.3)).alias("p"))
    assert "Python" not in df._jdf.queryExecution().toString()
