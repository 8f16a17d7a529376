"""Distribution tails as column algebra.

Log-gamma is a fixed series, the incomplete beta and gamma functions are series or continued fractions folded by
``aggregate`` over a sequence of steps. The number of steps grows with the square root of the parameters; a fold that
has converged passes its state on, and one that has not converged gives NULL, never a wrong value. A NULL or NaN
argument gives NULL. The functions are meant for aggregated rows (one per gene, pair or site).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients B(2k) / (2k (2k - 1)) of Stirling's series.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156, -3617 / 122400)


def normal_sf(z: float) -> float:
    """Upper tail of the standard normal distribution of a plain number."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _let(fn: Callable[[Column], Column], **values: Column) -> Column:
    """``fn`` of a struct of the values, each of them computed once."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in values.items()])), fn), F.lit(0))


def _number(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def _known(*args: Column) -> Column:
    total = sum(args[1:], args[0])
    return total.isNotNull() & ~F.isnan(total)


def _nonzero(c: Column) -> Column:
    return F.when(c == 0, 1e-300).otherwise(c)


def _fold(steps: Column, start: dict, step: Callable[[Column, Column], dict]) -> Column:
    """Fold ``step`` over 1..steps until ``now`` and ``last`` of the state agree; their value, NULL if they never do."""

    def packed(values: dict) -> Column:
        return F.struct(*[_number(c).alias(k) for k, c in values.items()])

    def settled(s: Column) -> Column:
        return F.abs(s["now"] - s["last"]) <= 1e-15 * F.abs(s["now"])

    return F.aggregate(
        F.sequence(F.lit(1), steps.cast("int")), packed(start),
        lambda s, i: F.when(settled(s), s).otherwise(packed(step(s, i.cast("double")))),
        lambda s: F.when(settled(s), s["now"]),
    )


def lgamma(x) -> Column:
    """Natural logarithm of the gamma function for x > 0."""

    def series(s: Column) -> Column:
        y, tail = s["y"], F.lit(0.0)
        for c in reversed(STIRLING):
            tail = tail * s["r"] + F.lit(c)
        return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + tail / y - F.ln(s["shift"])

    x = _number(x)
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(1.0), lambda s, i: s * (x + i))
    y = F.when(x < 10, x + 10).otherwise(x)
    low = F.when(x < 10, shift).otherwise(1.0)
    return F.when(x > 0, _let(series, y=y, r=1 / (y * y), shift=low))


def _log_beta(a: Column, b: Column) -> Column:
    terms = [F.struct(v.alias("v"), F.lit(sign).alias("sign")) for v, sign in ((a, 1.0), (b, 1.0), (a + b, -1.0))]
    return F.aggregate(F.array(*terms), F.lit(0.0), lambda s, t: s + t["sign"] * lgamma(t["v"]))


def _steps(size: Column) -> Column:
    return F.ceil(100 + 10 * F.sqrt(size))


def beta_inc(a, b, x) -> Column:
    """Regularised incomplete beta function."""
    a, b, x = _number(a), _number(b), _number(x)

    def side(s: Column) -> Column:
        a, b, x = s["v"]["a"], s["v"]["b"], s["v"]["x"]

        def step(acc: Column, m: Column) -> dict:
            # Two more terms of the fraction; numerators and denominators are divided by the newest denominator.
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            num, den = acc["now"] + even * acc["num"], 1 + even * acc["den"]
            unit = _nonzero(den + odd)
            return {"num": num / unit, "den": den / unit, "last": acc["now"], "now": (num + odd * acc["now"]) / unit}

        first = 1 / _nonzero(1 - (a + b) * x / (a + 1))
        value = _fold(_steps(F.greatest(a, b)), {"num": first, "den": first, "last": F.lit(0.0), "now": first}, step)
        log_front = a * F.ln(x) + b * F.ln(1 - x) - _log_beta(a, b)
        area = F.exp(log_front) * value / a
        return F.when(s["turned"], 1 - area).otherwise(area)

    turned = x >= (a + 1) / (a + b + 2)
    given = F.struct(a.alias("a"), b.alias("b"), x.alias("x"))
    other = F.struct(b.alias("a"), a.alias("b"), (1 - x).alias("x"))
    inside = _let(side, turned=turned, v=F.when(turned, other).otherwise(given))
    return F.when(_known(a, b, x), F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside))


def _gamma_parts(a: Column, x: Column) -> tuple[Column, Column]:
    """Lower part by its series (x below a + 1) and upper part by its fraction (x from a + 1 on)."""
    front = F.exp(a * F.ln(x) - x - lgamma(a))

    def term(acc: Column, n: Column) -> dict:
        more = acc["term"] * x / (a + n)
        return {"term": more, "last": acc["now"], "now": acc["now"] + more}

    def convergent(acc: Column, i: Column) -> dict:
        top, bottom = -i * (i - a), x + 1 - a + 2 * i
        unit = _nonzero(bottom + top * acc["den"])
        return {"num": acc["now"] / unit, "den": 1 / unit, "last": acc["now"], "now": (bottom * acc["now"] + top * acc["num"]) / unit}

    first = 1 / _nonzero(x + 1 - a)
    lower = _fold(_steps(a), {"term": 1 / a, "last": F.lit(0.0), "now": 1 / a}, term)
    upper = _fold(_steps(a), {"num": F.lit(0.0), "den": first, "last": F.lit(0.0), "now": first}, convergent)
    return front * lower, front * upper


def gamma_inc(a, x) -> Column:
    """Regularised lower incomplete gamma function."""

    def part(s: Column) -> Column:
        lower, upper = _gamma_parts(s["a"], s["x"])
        return F.when(s["x"] < s["a"] + 1, lower).otherwise(1 - upper)

    a, x = _number(a), _number(x)
    return F.when(_known(a, x), F.when(x <= 0, 0.0).otherwise(_let(part, a=a, x=x)))


def gamma_upper(a, x) -> Column:
    """Regularised upper incomplete gamma function; keeps its digits far out in the tail."""

    def part(s: Column) -> Column:
        lower, upper = _gamma_parts(s["a"], s["x"])
        return F.when(s["x"] < s["a"] + 1, 1 - lower).otherwise(upper)

    a, x = _number(a), _number(x)
    return F.when(_known(a, x), F.when(x <= 0, 1.0).otherwise(_let(part, a=a, x=x)))


def binom_ge(k, n, p) -> Column:
    """P(X >= k) for X binomial."""
    k, n, p = _number(k), _number(n), _number(p)
    return F.when(_known(k, n, p), F.when(k <= 0, 1.0).when(k > n, 0.0).otherwise(beta_inc(k, n - k + 1, p)))


def poisson_ge(k, rate) -> Column:
    """P(X >= k) for X Poisson."""
    k, rate = _number(k), _number(rate)
    return F.when(_known(k, rate), F.when(k <= 0, 1.0).otherwise(gamma_inc(k, rate)))


def chi2_sf(x, df) -> Column:
    return gamma_upper(_number(df) / 2, _number(x) / 2)


def normal_two_sided(z) -> Column:
    z = _number(z)
    return gamma_upper(F.lit(0.5), z * z / 2)


def t_two_sided(t, df) -> Column:
    """Two-sided p of Student's t; NULL without degrees of freedom."""
    t, df = _number(t), _number(df)
    return F.when(df > 0, beta_inc(df / 2, F.lit(0.5), df / (df + t * t)))


def t_quantile(q, df) -> Column:
    """Upper quantile (0.5 <= q < 1) of Student's t.

    Newton steps on the tail from 0: the tail is convex there, so every step stays below the quantile. Far out a step
    about doubles t, near the quantile the digits do.
    """

    def search(s: Column) -> Column:
        df = s["df"]

        def step(acc: Column, i: Column) -> dict:
            t = acc["now"]
            density = F.exp(s["log_c"] - (df + 1) / 2 * F.log1p(t * t / df))
            gain = (t_two_sided(t, df) - s["target"]) / (2 * density)
            # A step within rounding, of either sign, ends the search.
            return {"last": t, "now": F.when(gain > 1e-14 * t, t + gain).otherwise(t)}

        return _fold(F.lit(200), {"last": F.lit(-1.0), "now": F.lit(0.0)}, step)

    q, df = _number(q), _number(df)
    log_c = lgamma((df + 1) / 2) - lgamma(df / 2) - F.ln(df * math.pi) / 2
    return F.when(_known(q, df) & (df > 0) & (q >= 0.5) & (q < 1), _let(search, df=df, target=2 * (1 - q), log_c=log_c))


def gamma_quantile(q, shape, scale) -> Column:
    """Quantile (0 < q < 1) of the gamma distribution: halving between 0 and the one-sided Chebyshev bound."""

    def search(s: Column) -> Column:
        def halve(acc: Column, i: Column) -> Column:
            width = acc["width"] / 2
            below = gamma_inc(s["shape"], acc["low"] + width) < s["q"]
            return F.struct(F.when(below, acc["low"] + width).otherwise(acc["low"]).alias("low"), width.alias("width"))

        top = s["shape"] + F.sqrt(s["shape"] * s["q"] / (1 - s["q"]))
        start = F.struct(F.lit(0.0).alias("low"), top.alias("width"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, halve, lambda acc: acc["low"] + acc["width"])

    q, shape, scale = _number(q), _number(shape), _number(scale)
    ok = _known(q, shape, scale) & (q > 0) & (q < 1) & (shape > 0)
    return F.when(ok, _let(search, q=q, shape=shape) * scale)


def fisher_two_sided(a, b, c, d) -> Column:
    """Two-sided Fisher exact p of the table [[a, b], [c, d]]: sum of tables at most as likely.

    Weights of the tables relative to the given one come from the ratios of neighbouring tables, walked upwards and
    downwards; no factorial is needed.
    """
    a, b, c, d = (_number(v) for v in (a, b, c, d))

    def whole(s: Column) -> Column:
        a, b, c, d = s["a"], s["b"], s["c"], s["d"]

        def walk(n: Column, ratio: Callable[[Column], Column]) -> Column:
            """(weights of rarer tables, of all tables) over the n tables on one side."""

            def merge(acc: Column, i: Column) -> Column:
                log_w = acc["log_w"] + F.ln(ratio(i.cast("double")))
                return F.struct(
                    log_w.alias("log_w"), (acc["rare"] + F.when(log_w <= 1e-7, F.exp(log_w)).otherwise(0.0)).alias("rare"),
                    (acc["all"] + F.exp(log_w)).alias("all"),
                )

            zero = F.struct(F.lit(0.0).alias("log_w"), F.lit(0.0).alias("rare"), F.lit(0.0).alias("all"))
            steps = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(steps, zero, merge)

        up = walk(F.least(b, c), lambda i: (b - i) * (c - i) / ((a + i + 1) * (d + i + 1)))
        down = walk(F.least(a, d), lambda i: (a - i) * (d - i) / ((b + i + 1) * (c + i + 1)))
        return _let(
            lambda w: F.least(F.lit(1.0), (1 + w["up"]["rare"] + w["down"]["rare"]) / (1 + w["up"]["all"] + w["down"]["all"])), up=up, down=down
        )

    return F.when(_known(a, b, c, d), _let(whole, a=a, b=b, c=c, d=d))
