"""Plain numbers against which the column forms of ``variascope.functions.tails`` are held."""

from __future__ import annotations

import itertools
import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in itertools.count(1):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if math.isnan(a + b + x):
        return math.nan
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if math.isnan(a + x):
        return math.nan
    if x <= 0.0:
        return 0.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while term >= total * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return lead * total
    return 1.0 - gamma_upper(a, x)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function; keeps its digits far out in the tail."""
    if math.isnan(a + x):
        return math.nan
    if x < a + 1.0:
        return 1.0 - gamma_inc(a, x)
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in itertools.count(1):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return math.exp(a * math.log(x) - x - math.lgamma(a)) * h


def binom_ge(k: float, n: float, p: float) -> float:
    """P(X >= k) for X binomial."""
    if k <= 0:
        return 1.0
    return 0.0 if k > n else beta_inc(k, n - k + 1.0, p)


def poisson_ge(k: float, rate: float) -> float:
    """P(X >= k) for X Poisson."""
    return 1.0 if k <= 0 else gamma_inc(k, rate)


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def t_two_sided(t: float, df: float) -> float:
    if df <= 0 or math.isnan(t):
        return math.nan
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(q: float, df: float) -> float:
    """Upper quantile (q >= 0.5) of Student's t by bisection on the tail."""
    target = 2.0 * (1.0 - q)
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_two_sided(mid, df) > target else (low, mid)
    return (low + high) / 2.0


def gamma_quantile(q: float, shape: float, scale: float) -> float:
    low, high = 0.0, 1.0
    while gamma_inc(shape, high) < q:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if gamma_inc(shape, mid) < q else (low, mid)
    return (low + high) / 2.0 * scale


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p of the table [[a, b], [c, d]]: sum of tables at most as likely."""
    row, col, n = a + b, a + c, a + b + c + d

    def log_p(x: int) -> float:
        return (
            math.lgamma(row + 1) - math.lgamma(x + 1) - math.lgamma(row - x + 1)
            + math.lgamma(n - row + 1) - math.lgamma(col - x + 1) - math.lgamma(n - row - col + x + 1)
            - math.lgamma(n + 1) + math.lgamma(col + 1) + math.lgamma(n - col + 1)
        )

    low, high = max(0, col - (n - row)), min(row, col)
    limit = log_p(a) + 1e-7
    return min(1.0, sum(math.exp(v) for v in (log_p(x) for x in range(low, high + 1)) if v <= limit))


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p without ties: counts of subsets by U through the usual recurrence."""
    n1, n2 = min(n1, n2), max(n1, n2)
    ways = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for s in range(len(ways) - 1, n2 + i - 1, -1):
            ways[s] -= ways[s - n2 - i]
        for s in range(i, len(ways)):
            ways[s] += ways[s - i]
    big = max(u, n1 * n2 - u)
    return min(1.0, 2.0 * sum(ways[int(math.ceil(big)) :]) / sum(ways))
