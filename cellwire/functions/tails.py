"""Distribution tails that Spark lacks, as Arrow-batched pandas UDFs.

The number of rows that reach these functions is the number of tests (records or features),
never the number of cells or edges.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by a continued fraction (Lentz), vectorised."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    swap = inside > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - inside, inside)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(
        lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(t) + q * np.log1p(-t)
    ) / p
    tiny = 1e-300
    c = np.ones_like(t)
    d = 1 - (p + q) * t / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, 400):
        for numerator in (
            m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total = total * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    value = front * total
    value = np.where(swap, 1 - value, value)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def beta_quantile(prob: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inverse of the incomplete beta function by bisection."""
    prob, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (prob, a, b)))
    low, high = np.zeros(prob.shape), np.ones(prob.shape)
    for _ in range(100):
        middle = (low + high) / 2
        below = incomplete_beta(a, b, middle) < prob
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def t_two_sided(statistic: np.ndarray, df: np.ndarray) -> np.ndarray:
    statistic, df = np.asarray(statistic, dtype=float), np.asarray(df, dtype=float)
    return incomplete_beta(df / 2, 0.5, df / (df + statistic * statistic))


def t_quantile(prob: float, df: np.ndarray) -> np.ndarray:
    """Upper t quantile for prob > 0.5."""
    x = beta_quantile(np.full(np.shape(df), 2 * (1 - prob)), np.asarray(df, float) / 2, 0.5)
    return np.sqrt(np.asarray(df, float) * (1 - x) / x)


@F.pandas_udf(T.DoubleType())
def normal_upper_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), na_action="ignore").astype(float)


def _where_known(function, *series: pd.Series) -> pd.Series:
    known = np.logical_and.reduce([s.notna().to_numpy() for s in series])
    out = np.full(len(series[0]), np.nan)
    if known.any():
        out[known] = function(*(s.to_numpy(dtype=float)[known] for s in series))
    return pd.Series(out).where(known, None)


@F.pandas_udf(T.DoubleType())
def t_two_sided_tail(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return _where_known(t_two_sided, statistic, df)


@F.pandas_udf(T.DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    """97.5 % quantile of the t distribution."""
    return _where_known(lambda d: t_quantile(0.975, d), df)


@F.pandas_udf(T.DoubleType())
def exact_binomial_lower(successes: pd.Series, trials: pd.Series, confidence: pd.Series) -> pd.Series:
    def lower(k, n, level):
        alpha = (1 - level) / 2
        return np.where(k == 0, 0.0, beta_quantile(alpha, np.maximum(k, 1), n - k + 1))

    return _where_known(lower, successes, trials, confidence)


@F.pandas_udf(T.DoubleType())
def exact_binomial_upper(successes: pd.Series, trials: pd.Series, confidence: pd.Series) -> pd.Series:
    def upper(k, n, level):
        alpha = (1 - level) / 2
        return np.where(k == n, 1.0, beta_quantile(1 - alpha, k + 1, np.maximum(n - k, 1)))

    return _where_known(upper, successes, trials, confidence)
