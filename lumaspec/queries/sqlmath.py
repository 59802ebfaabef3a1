"""Tail probabilities as DuckDB expressions, for the SQL beside the queries.

Continued fractions and series are folded from their far end, so they are plain
scalar expressions. Arguments are SQL expressions.
"""

from __future__ import annotations

TERMS = 400
_DOWN = f"list_transform(range({TERMS}, 0, -1), lambda k: CAST(k AS DOUBLE))"


def _beta_fraction(a: str, b: str, x: str) -> str:
    step = f"1 + CASE WHEN k % 2 = 0 THEN (k / 2) * ({b} - k / 2) * ({x}) ELSE -({a} + (k - 1) / 2) * ({a} + {b} + (k - 1) / 2) * ({x}) END / (({a} + k - 1) * ({a} + k)) / acc"
    return f"list_reduce({_DOWN}, lambda acc, k: {step}, CAST(1 AS DOUBLE))"


def beta_share(a: str, b: str, x: str) -> str:
    """Regularised incomplete beta function."""
    a, b, x = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)", f"CAST({x} AS DOUBLE)"
    front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x}))"
    left = f"{front} / {a} / {_beta_fraction(a, b, x)}"
    right = f"1 - {front} / {b} / {_beta_fraction(b, a, f'(1 - {x})')}"
    return f"CASE WHEN {x} <= 0 THEN 0 WHEN {x} >= 1 THEN 1 WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {left} ELSE {right} END"


def t_p(t: str, df: str) -> str:
    """Two-sided, of Student's t."""
    return beta_share(f"(({df}) / 2.0)", "0.5", f"(({df}) / (({df}) + ({t}) * ({t})))")


def f_p(f: str, d1: str, d2: str) -> str:
    """Upper tail of F."""
    return beta_share(f"(({d2}) / 2.0)", f"(({d1}) / 2.0)", f"(({d2}) / (({d2}) + ({d1}) * ({f})))")


def gamma_tail(a: str, x: str, terms: int = TERMS) -> str:
    """Regularised upper incomplete gamma function."""
    down = _DOWN.replace(str(TERMS), str(terms))
    a, x = f"CAST({a} AS DOUBLE)", f"CAST({x} AS DOUBLE)"
    front = f"exp(-{x} + {a} * ln({x}) - lgamma({a}))"
    series = f"list_reduce({down}, lambda acc, k: 1 + {x} / ({a} + k) * acc, CAST(1 AS DOUBLE))"
    fraction = f"list_reduce({down}, lambda acc, k: {x} + 2 * k - 1 - {a} - k * (k - {a}) / acc, {x} + {2 * terms + 1} - {a})"
    return f"CASE WHEN {x} <= 0 THEN 1 WHEN {x} < {a} + 1 THEN 1 - {front} / {a} * {series} ELSE {front} / {fraction} END"


def chi2_p(x: str, df: str) -> str:
    return gamma_tail(f"(({df}) / 2.0)", f"(({x}) / 2.0)")


def normal_p(z: str) -> str:
    """Two-sided, of the normal distribution."""
    return gamma_tail("0.5", f"(({z}) * ({z}) / 2.0)")


def normal_cdf(z: str, terms: int = 120) -> str:
    tail = gamma_tail("0.5", f"(({z}) * ({z}) / 2.0)", terms)
    return f"(CASE WHEN ({z}) < 0 THEN ({tail}) / 2 ELSE 1 - ({tail}) / 2 END)"


def normal_quantile(p: str) -> str:
    """By Newton's method from 0."""
    step = f"z - ({normal_cdf('z')} - ({p})) / (exp(-z * z / 2) / sqrt(2 * pi()))"
    return f"list_reduce(range(40), lambda z, i: {step}, CAST(0 AS DOUBLE))"


def range_p(rows: str, keys: str) -> str:
    """``rows`` (keys, q, k, df) with p_value: the upper tail of the studentised range, by Simpson's rule over the scale and over the normal variable."""
    log_f = "df / 2 * ln(df) + (df - 1) * ln(s) - df * s * s / 2 - (df / 2 - 1) * ln(2) - lgamma(df / 2)"
    return f"""(WITH r AS (SELECT * FROM {rows} _r), n AS (SELECT r.*, 1 + (i / 20.0 - 1) * 8 / sqrt(2 * df) AS s, CASE WHEN i IN (0, 40) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * 8 / sqrt(2 * df) / 60 AS ws FROM r, range(41) t(i)),
z AS (SELECT -8 + i / 10.0 AS z, CASE WHEN i IN (0, 160) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 30.0 AS wz, {normal_cdf('(-8 + i / 10.0)')} AS cz FROM range(161) t(i)),
w AS (SELECT {keys}, any_value(q) AS q, any_value(k) AS k, any_value(df) AS df, s, any_value(ws) AS ws, any_value(k) * sum(wz * exp(-z * z / 2) / sqrt(2 * pi()) * (cz - {normal_cdf('(z - q * s)')}) ** (k - 1)) AS inside FROM n, z GROUP BY {keys}, s)
SELECT {keys}, 1 - sum(ws * exp({log_f}) * inside) AS p_value FROM w GROUP BY {keys})"""


def bh(rows: str, keys: str, p: str = "p_value") -> str:
    """``rows`` with p_adj by Benjamini and Hochberg; NULL stays NULL and does not count."""
    return f"""(SELECT *, CASE WHEN {p} IS NULL THEN NULL ELSE least(1.0, min({p} * _m / _r) OVER (PARTITION BY {p} IS NULL ORDER BY {p} DESC, _r DESC ROWS UNBOUNDED PRECEDING)) END AS p_adj
FROM (SELECT *, row_number() OVER (PARTITION BY {p} IS NULL ORDER BY {p}, {keys}) AS _r, count({p}) OVER () AS _m FROM {rows} _x))"""


def stars(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 'nd' WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'ns' END"
