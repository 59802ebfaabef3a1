"""Distribution functions in NumPy, and as Spark functions over Arrow batches.

Spark has neither an incomplete beta nor an incomplete gamma function, so tails
are computed here: the beta function by a continued fraction, the gamma
function by series or continued fraction, the studentised range by nested
Gauss-Legendre quadrature.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)  # fixed values


def lgamma(x):
    x = np.asarray(x, dtype=float) - 1
    s = np.full_like(x, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        s = s + c / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(s)


def beta_inc(a, b, x, steps: int = 300):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)], out[ok & (x == 1)] = 0.0, 1.0
    inner = ok & (x > 0) & (x < 1)
    if not inner.any():
        return out
    p, q, z = a[inner], b[inner], x[inner]
    swap = z >= (p + 1) / (p + q + 2)
    p, q, z = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - z, z)
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, steps):
        for k in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = front * h
    out[inner] = np.where(swap, 1 - value, value)
    return out


def gamma_q(a, x):
    """Regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    for i in np.argwhere(ok & (x > 0)):
        i = tuple(i)
        s, z = float(a[i]), float(x[i])
        scale = math.exp(-z + s * math.log(z) - math.lgamma(s)) if z < 700 + s * 5 else 0.0
        if z < s + 1:
            term = total = 1 / s
            n = s
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= z / n
                total += term
            out[i] = 1 - total * scale
        else:
            b = z + 1 - s
            c, d = 1e300, 1 / b
            h = d
            for k in range(1, 1000):
                an = -k * (k - s)
                b += 2
                d = 1 / (an * d + b or 1e-300)
                c = b + an / c or 1e-300
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            out[i] = scale * h
    return out


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(invalid="ignore", over="ignore"):
        p = beta_inc(df / 2, 0.5, df / (df + np.where(np.isinf(t), 0, t) ** 2))
    return np.where(np.isinf(t), 0.0, np.where(np.isnan(t), np.nan, p))


def f_tail(f, d1, d2):
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (f, d1, d2)))
    return np.where(np.isnan(f), np.nan, beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(np.nan_to_num(f), 0))))


def chi2_tail(x, k):
    return gamma_q(np.asarray(k, dtype=float) / 2, np.asarray(x, dtype=float) / 2)


_ERFC = np.vectorize(math.erfc, otypes=[float])


def normal_two_sided(z):
    return _ERFC(np.abs(np.asarray(z, dtype=float)) / math.sqrt(2))


def normal_quantile(p):
    """By bisection on the tail, elementwise."""
    return np.array([_bisect(lambda z, q=float(x): 0.5 * math.erfc(-z / math.sqrt(2)) - q, -40, 40) for x in np.atleast_1d(p)])


def _bisect(f, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    """Quantile of level p above one half."""
    return _bisect(lambda t: 1 - float(t_two_sided(t, df)) / 2 - p, 0, 1e6)


def f_quantile(p: float, d1: float, d2: float) -> float:
    return _bisect(lambda f: 1 - float(f_tail(f, d1, d2)) - p, 0, 1e6)


@lru_cache(maxsize=4)
def _legendre(n: int):
    return np.polynomial.legendre.leggauss(n)


def studentised_range_tail(q: float, k: int, df: float) -> float:
    """P(range of k means / s >= q)."""
    if not np.isfinite(q):
        return float("nan") if np.isnan(q) else 0.0
    x, w = _legendre(96)
    z = 8 * x

    def inner(r: float) -> float:
        phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        upper, lower = 0.5 * _ERFC(-z / math.sqrt(2)), 0.5 * _ERFC(-(z - r) / math.sqrt(2))
        return float(np.sum(8 * w * phi * k * np.maximum(upper - lower, 0) ** (k - 1)))

    if not np.isfinite(df) or df > 25_000:
        return max(0.0, 1 - inner(q))
    low, high = max(0.0, 1 - 9 / math.sqrt(2 * df)), 1 + 9 / math.sqrt(2 * df)
    if df < 10:
        low, high = 0.0, 1 + 12 / math.sqrt(df)
    s = (high - low) / 2 * x + (high + low) / 2
    log_density = df / 2 * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2) + (df - 1) * np.log(np.maximum(s, 1e-300)) - df * s * s / 2
    return min(1.0, max(0.0, 1 - float(np.sum((high - low) / 2 * w * np.exp(log_density) * np.array([inner(q * v) for v in s])))))


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t, df)).where(t.notna() & df.notna())


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_tail(f, d1, d2)).where(f.notna())


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_tail(x.fillna(0), k)).where(x.notna())


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z)).where(z.notna())


@F.pandas_udf(DoubleType())
def range_p_value(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([studentised_range_tail(*v) if pd.notna(v[0]) else None for v in zip(q, k, df, strict=True)], dtype=float)
