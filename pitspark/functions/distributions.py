"""Normal and Student-t functions Spark SQL lacks (F8, F9), as Arrow batches."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function: a series of positive terms up to 2.5, a continued fraction beyond."""
    a = np.abs(np.asarray(x, np.float64))
    low, high = np.minimum(a, 2.5), np.maximum(a, 2.5)
    term = total = low.copy()
    for k in range(1, 60):
        term = term * (2 * low * low / (2 * k + 1))
        total = total + term
    small = 1.0 - 2.0 / math.sqrt(math.pi) * np.exp(-low * low) * total
    tail = np.zeros_like(high)
    for k in range(120, 0, -1):
        tail = (k / 2.0) / (high + tail)
    large = np.exp(-high * high) / (math.sqrt(math.pi) * (high + tail))
    one_sided = np.where(a < 2.5, small, large)
    return np.where(np.asarray(x) >= 0, one_sided, 2.0 - one_sided)


@F.pandas_udf(T.DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    """Standard normal quantile; null outside (0, 1). A rational start, then Halley steps on the tail."""
    v = p.to_numpy(np.float64, na_value=np.nan)
    fine = (v > 0) & (v < 1)
    q = np.where(fine, np.minimum(v, 1 - v), 0.5)
    t = np.sqrt(-2 * np.log(q))
    x = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    for _ in range(3):
        density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        step = (0.5 * erfc(x / math.sqrt(2)) - q) / density
        x = x + step / (1 + x * step / 2)
    return pd.Series(np.where(fine, np.where(v < 0.5, -x, x), np.nan))


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    v = z.to_numpy(np.float64, na_value=np.nan)
    return pd.Series(np.where(np.isnan(v), np.nan, 0.5 * erfc(np.where(np.isnan(v), 0.0, -v / math.sqrt(2)))))


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return total


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return scale * beta_fraction(a, b, x) / a
    return 1 - scale * beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def _two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([incomplete_beta(v / 2, 0.5, v / (v + s * s)) if s == s and v > 0 else None
                      for s, v in zip(t, df)], dtype="float64")


def t_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| > |t|) with df degrees of freedom."""
    return _two_sided(t.cast("double"), df.cast("double"))
