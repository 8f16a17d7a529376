"""Tails of distributions in DuckDB SQL for the twins: finite sums that share nothing with the folds of ``functions.tails``."""

from __future__ import annotations


def t_two_sided(t: str, df: str) -> str:
    """Student's t with whole degrees of freedom: the finite sum over powers of the cosine of atan(t / sqrt(df))."""
    sine, cosine = f"(abs({t}) / sqrt({df} + {t} * {t}))", f"(1 / sqrt(1 + {t} * {t} / {df}))"
    odd = f"exp(0.5 * ln(pi()) + lgamma(j) - ln(2.0) - lgamma(j + 0.5) + (2 * j - 1) * ln({cosine}))"
    even = f"exp(lgamma(j + 0.5) - lgamma(j + 1) - 0.5 * ln(pi()) + 2 * j * ln({cosine}))"

    def total(term: str, low: int, high: str) -> str:
        return f"coalesce(list_sum(list_transform(range({low}, CAST({high} AS BIGINT)), lambda j: {term})), 0)"

    return (
        f"greatest(0, 1 - CASE WHEN {df} % 2 = 1 THEN 2 / pi() * (atan(abs({t}) / sqrt({df})) + {sine} * {total(odd, 1, f'({df} - 1) // 2 + 1')})"
        f" ELSE {sine} * {total(even, 0, f'{df} // 2')} END)"
    )


def fisher_two_sided(a: str, b: str, c: str, d: str) -> str:
    """Sum of the hypergeometric probabilities that are at most the one of the table."""

    def log_p(x: str) -> str:
        cells = (x, f"({a} + {b} - {x})", f"({a} + {c} - {x})", f"({d} - {a} + {x})")
        sides = (f"{a} + {b}", f"{c} + {d}", f"{a} + {c}", f"{b} + {d}")
        plus = " + ".join(f"lgamma({s} + 1)" for s in sides)
        return f"({plus} - lgamma({a} + {b} + {c} + {d} + 1) - " + " - ".join(f"lgamma({s} + 1)" for s in cells) + ")"

    tables = f"range(greatest(0, {a} - {d}), least({a} + {b}, {a} + {c}) + 1)"
    return f"least(1, list_sum(list_transform(list_filter({tables}, lambda x: {log_p('x')} <= {log_p(a)} + 1e-7), lambda x: exp({log_p('x')}))))"


def normal_two_sided(z: str) -> str:
    """Series of the error function in odd powers over double factorials."""
    term = f"exp((2 * n + 1) * ln({z}) - (n + 1) * ln(2.0) - lgamma(n + 1.5) + 0.5 * ln(pi()))"
    return f"CASE WHEN {z} = 0 THEN 1 ELSE greatest(0, 1 - 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(400), lambda n: {term}))) END"


def t_quantiles(source: str, tail: float) -> str:
    """CTEs (of a recursive WITH) with ``tq(df, q)``: halving for every ``df`` of the source."""
    mid = "((low + high) / 2)"
    return f"""tb AS (SELECT DISTINCT df, 0.0::DOUBLE AS low, 1000.0::DOUBLE AS high, 0 AS step FROM {source} WHERE df > 0
    UNION ALL SELECT df, CASE WHEN p > {tail} THEN m ELSE low END, CASE WHEN p > {tail} THEN high ELSE m END, step + 1
    FROM (SELECT *, {t_two_sided('m', 'df')} AS p FROM (SELECT *, {mid} AS m FROM tb WHERE step < 60) q1) q2),
    tq AS (SELECT df, low AS q FROM tb WHERE step = 60)"""
