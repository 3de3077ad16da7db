"""Small special functions used on aggregated rows (one row per test, never per sample)."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 2000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def beta_inv(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if beta_inc(a, b, mid) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def log_pmf(k: int, n: int, p: float) -> float:
    if p <= 0 or p >= 1:
        return 0.0 if k == (n if p >= 1 else 0) else -math.inf
    return (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
            + k * math.log(p) + (n - k) * math.log1p(-p))


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Sum of all outcome probabilities not above that of ``k`` (relative slack 1e-7).

    The distribution has one mode, so the outcomes form two tails; their ends are found by bisection
    and summed as beta functions - logarithmic in n.
    """
    cut = log_pmf(k, n, p) + math.log1p(1e-7)
    mode = min(n, int((n + 1) * p))
    if log_pmf(mode, n, p) <= cut:
        return 1.0
    lo, hi = -1, mode            # last k in the lower tail
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if log_pmf(mid, n, p) <= cut else (lo, mid)
    lower = 0.0 if lo < 0 else 1.0 - beta_inc(lo + 1, n - lo, p)
    a, b = mode, n + 1           # first k in the upper tail
    while b - a > 1:
        mid = (a + b) // 2
        a, b = (a, mid) if log_pmf(mid, n, p) <= cut else (mid, b)
    upper = 0.0 if b > n else beta_inc(b, n - b + 1, p)
    return min(1.0, lower + upper)


_INTERVAL = T.StructType([T.StructField(c, T.DoubleType()) for c in ("ci_lo", "ci_hi", "p")])


def ratio_interval(alpha: float = 0.05):
    """Pandas UDF (n1, e1, n0, e0) -> exact conditional interval of the rate ratio and two-sided p."""

    @F.pandas_udf(_INTERVAL)
    def interval(n1: pd.Series, e1: pd.Series, n0: pd.Series, e0: pd.Series) -> pd.DataFrame:
        rows = []
        for a, ea, b, eb in zip(n1, e1, n0, e0):
            if pd.isna(a) or pd.isna(b) or a + b == 0 or not ea > 0 or not eb > 0:
                rows.append((None, None, None))
                continue
            a, n = int(a), int(a + b)
            low = 0.0 if a == 0 else beta_inv(alpha / 2, a, n - a + 1)
            high = 1.0 if a == n else beta_inv(1 - alpha / 2, a + 1, n - a)
            upper = math.inf if high >= 1 else high / (1 - high) * eb / ea
            rows.append((low / (1 - low) * eb / ea, upper, binomial_two_sided(a, n, ea / (ea + eb))))
        return pd.DataFrame(rows, columns=["ci_lo", "ci_hi", "p"])

    return interval


@F.pandas_udf(T.DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else NormalDist().cdf(v))


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(lambda v: NormalDist().inv_cdf(v) if pd.notna(v) and 0 < v < 1 else None)
