"""Distributions and estimators: expressions where Spark has them, series and root searches in pandas functions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lanczos coefficients (g = 7, n = 9); fixed values.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 0.5, by Lanczos' series; a native expression."""
    y = x.cast("double") - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + i)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.ln(t) - t + F.ln(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def normal_pdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


def beta_log_pdf(x: Column, a: Column, b: Column) -> Column:
    return (a - 1) * F.ln(x) + (b - 1) * F.ln(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)


def beta_pdf(x: Column, a: Column, b: Column) -> Column:
    return F.exp(beta_log_pdf(x, a, b))


def beta_partial_log_pdf(x: Column, a: Column, b: Column) -> Column:
    """Without the normalising constant."""
    return (a - 1) * F.ln(x) + (b - 1) * F.ln(1 - x)


def beta_mean(a: Column, b: Column) -> Column:
    return a / (a + b)


def beta_variance(a: Column, b: Column) -> Column:
    return a * b / ((a + b) * (a + b) * (a + b + 1))


def beta_mode(a: Column, b: Column) -> Column:
    """NULL unless both parameters exceed 1."""
    return F.when((a > 1) & (b > 1), (a - 1) / (a + b - 2))


def binomial_pdf(k: Column, n: Column, p: Column) -> Column:
    inside = log_choose(n, k) + F.when(k == 0, 0.0).otherwise(k * F.ln(p)) + F.when(k == n, 0.0).otherwise((n - k) * F.ln(1 - p))
    return F.when((k < 0) | (k > n), 0.0).otherwise(F.exp(inside))


def beta_binomial_log_pdf(k: Column, n: Column, a: Column, b: Column) -> Column:
    return log_choose(n, k) + log_gamma(k + a) + log_gamma(n - k + b) - log_gamma(n + a + b) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)


def beta_binomial_pdf(k: Column, n: Column, a: Column, b: Column) -> Column:
    return F.exp(beta_binomial_log_pdf(k, n, a, b))


def beta_binomial_moments(n: int, counts: list[float]) -> tuple[float, float]:
    """(a, b) of n trials by the method of moments from counts of 0 to n successes."""
    total = sum(counts)
    m1 = sum(k * c for k, c in enumerate(counts)) / total
    m2 = sum(k * k * c for k, c in enumerate(counts)) / total
    d = n * (m2 / m1 - m1 - 1) + m1
    return (n * m1 - m2) / d, (n - m1) * (n - m2 / m1) / d


def poisson_pdf(k: Column, mean: Column) -> Column:
    return F.exp(k * F.ln(mean) - mean - log_gamma(k + 1))


def negative_binomial_pdf(k: Column, r: Column, p: Column) -> Column:
    return F.exp(log_gamma(k + r) - log_gamma(k + 1) - log_gamma(r) + r * F.ln(p) + k * F.ln(1 - p))


def hypergeometric_log(k: int, K: int, n: int, N: int) -> float:
    lc = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    return lc(K, k) + lc(N - K, n - k) - lc(N, n)


def hypergeometric_pdf(k: int, K: int, n: int, N: int) -> float:
    """k is clamped to the support."""
    k = min(max(k, max(0, n + K - N)), min(n, K))
    return math.exp(hypergeometric_log(k, K, n, N))


def hypergeometric_cdf(k: int, K: int, n: int, N: int) -> float:
    low, high = max(0, n + K - N), min(n, K)
    k = min(max(k, low), high)
    return min(1.0, sum(math.exp(hypergeometric_log(i, K, n, N)) for i in range(low, k + 1)))


def hypergeometric_quantile(p: float, K: int, n: int, N: int) -> int:
    low, high = max(0, n + K - N), min(n, K)
    total = 0.0
    for k in range(low, high + 1):
        total += math.exp(hypergeometric_log(k, K, n, N))
        if total >= p:
            return k
    return high


def hypergeometric_upper(k: int, K: int, n: int, N: int, compat: bool = True) -> float:
    """P(X >= k) as 1 - cdf(k - 1); with compat k = 0 isn't lowered, and cdf clamps what lies below the support."""
    if compat:
        return 1 - hypergeometric_cdf(k - 1 if k > 0 else 0, K, n, N)
    return 1.0 if k <= max(0, n + K - N) else 1 - hypergeometric_cdf(k - 1, K, n, N)


def hypergeometric_tail(first: int, K: int, n: int, N: int) -> float:
    """P(X >= first), from ratios of neighbouring terms: no difference of large logarithms but far from the mode.

    Terms are weighed against the one at the mode and divided by their sum; those 14 standard deviations away are below its rounding.
    """
    low, high = max(0, n + K - N), min(n, K)
    if first > high:
        return 0.0
    if first <= low:
        return 1.0
    mode = min(max((n + 1) * (K + 1) // (N + 2), low), high)
    reach = 40 + int(14 * math.sqrt(n * (K / N) * (1 - K / N) * (1 - n / N) * N / max(N - 1, 1)))

    def up(i: int, k: int) -> np.ndarray:
        """Weights of i + 1 to k, that of i being 1."""
        x = np.arange(i, k, dtype=float)
        return np.cumprod((K - x) * (n - x) / ((x + 1) * (N - K - n + x + 1)))

    if first > mode + reach:
        return math.exp(hypergeometric_log(first, K, n, N)) * (1 + float(up(first, min(high, first + reach)).sum()))
    above = up(mode, min(high, max(first, mode) + reach))
    x = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    below = np.cumprod(x * (N - K - n + x) / ((K - x + 1) * (n - x + 1)))
    total = 1 + above.sum() + below.sum()
    part = above[first - mode - 1 :].sum() if first > mode else 1 + above.sum() + below[: mode - first].sum()
    return float(part / total)


def hypergeometric_lower(k: int, K: int, n: int, N: int) -> float:
    return hypergeometric_cdf(k, K, n, N)


def gamma_cdf(x: float, shape: float, scale: float = 1.0) -> float:
    """Regularised lower incomplete gamma function: a series below shape + 1, a continued fraction above."""
    x = x / scale
    if x <= 0:
        return 0.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1 / shape
        n = shape
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c = x + 1 - shape, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - shape)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def gamma_pdf(x: float, shape: float, scale: float = 1.0) -> float:
    return math.exp((shape - 1) * math.log(x / scale) - x / scale - math.lgamma(shape)) / scale if x > 0 else 0.0


def bisect(f: Callable[[float], float], low: float, high: float, rounds: int = 200) -> float:
    """Root of an increasing function."""
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def gamma_quantile(p: float, shape: float, scale: float = 1.0) -> float:
    high = shape + 1
    while gamma_cdf(high, shape) < p:
        high *= 2
    return scale * bisect(lambda x: gamma_cdf(x, shape) - p, 0.0, high)


def poisson_cdf(k: int, mean: float) -> float:
    return 1 - gamma_cdf(mean, k + 1)


def poisson_quantile(p: float, mean: float) -> int:
    k = 0
    while poisson_cdf(k, mean) < p:
        k += 1
    return k


def binomial_cdf(k: int, n: int, p: float) -> float:
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)) * p**i * (1 - p) ** (n - i) for i in range(0, min(k, n) + 1)))


def negative_binomial_cdf(k: int, r: float, p: float) -> float:
    return min(1.0, sum(math.exp(math.lgamma(i + r) - math.lgamma(i + 1) - math.lgamma(r) + r * math.log(p) + i * math.log(1 - p)) for i in range(k + 1)))


def negative_binomial_quantile(q: float, r: float, p: float) -> int:
    k = 0
    while negative_binomial_cdf(k, r, p) < q:
        k += 1
    return k


def minimise(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-6) -> float:
    """Golden section search for the minimum of a function of one variable within bounds."""
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = f(x), f(y)
    while b - a > tolerance:
        if fx < fy:
            b, y, fy = y, x, fx
            x = b - g * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + g * (b - a)
            fy = f(y)
    return (a + b) / 2


def converged(values: list[float], n: int, tolerance: float) -> bool:
    """Whether the last n values differ by up to tolerance from one to the next."""
    last = values[-n:]
    return len(last) == n and all(abs(a - b) <= tolerance for a, b in zip(last, last[1:], strict=False))


def vectorised(f: Callable[..., float]):
    """A pandas function of double columns from a scalar function; nulls stay null."""

    @F.pandas_udf(T.DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        out = [None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*columns, strict=True)]
        return pd.Series(out, dtype="float64")

    return run


def entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())
