"""Tail functions without SciPy, as Arrow-batched UDFs over plain doubles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-300


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= (step := d * c)
        if abs(step - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, k: float) -> float:
    return max(TINY, gamma_q(k / 2, x / 2))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz's continued fraction of the incomplete beta function, for whole arrays."""
    tiny = 1e-300
    clean = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / clean(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 20_000):
        num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / clean(1 + num * d), clean(1 + num / c)
        h = h * d * c
        num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / clean(1 + num * d), clean(1 + num / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) for 0 < x < 1."""
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    part = _beta_fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)) * front / np.where(low, a, b)
    return np.where(low, part, 1 - part)


def binom_sf_array(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= k): I_p(k, n - k + 1)."""
    inner = (k > 0) & (k <= n) & (p > 0) & (p < 1)
    out = np.where((k <= 0) | (p >= 1), 1.0, TINY)
    out = np.where(k > n, TINY, out)
    if inner.any():
        out[inner] = np.clip(beta_inc(k[inner], n[inner] - k[inner] + 1, p[inner]), TINY, 1.0)
    return out


def binom_sf(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return float(binom_sf_array(np.array([k], float), np.array([n], float), np.array([p], float))[0])


def binom_two_sided(k: int, n: int, p: float) -> float:
    """Exact two-sided binomial: the mass of all outcomes no likelier than k."""
    i = np.arange(n + 1)
    logs = math.lgamma(n + 1) - _lgamma(i + 1) - _lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, float(np.exp(logs[logs <= logs[k] + math.log1p(1e-7)]).sum()))


def _udf(f):
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*cols, strict=True)], dtype="float64")

    return run


@F.pandas_udf(T.DoubleType())
def norm_sf_col(z: pd.Series) -> pd.Series:
    return _udf(norm_sf)(z)


@F.pandas_udf(T.DoubleType())
def chi2_sf_col(x: pd.Series, k: pd.Series) -> pd.Series:
    return _udf(chi2_sf)(x, k)


@F.pandas_udf(T.DoubleType())
def binom_sf_col(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    x = np.stack([c.to_numpy(float) for c in (k, n, p)])
    fit = ~np.isnan(x).any(axis=0)
    out = np.full(x.shape[1], np.nan)
    out[fit] = binom_sf_array(*(c[fit] for c in x))
    return pd.Series(out).astype(object).where(fit, None)
