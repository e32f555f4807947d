"""Exact binomial statistics for grouped counts.

These run on tables with one row per group, after aggregation. The tail
probability is the regularised incomplete beta function: a continued fraction as
long as one parameter is below ``LARGE``, and Gauss quadrature of the beta density
around its mode above that, so the cost does not grow with the counts. Logarithms
of gamma functions are never subtracted where they are large; their difference is
written out by Stirling's series. A continued fraction that doesn't converge is an
error, never a result.
"""

from __future__ import annotations

from math import lgamma, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LARGE = 3000.0
_TINY = 1e-300
_TERMS = 100_000
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(128)
_log_gamma = np.vectorize(lgamma, otypes=[float])


def _series(m: np.ndarray) -> np.ndarray:
    """What Stirling's formula leaves over of log(m!), for m of 30 or more."""
    return 1 / (12 * m) - 1 / (360 * m**3) + 1 / (1260 * m**5)


def _log_front(p: np.ndarray, q: np.ndarray, log_y: np.ndarray, log_rest: np.ndarray) -> np.ndarray:
    """log of y**p * (1 - y)**q / B(p, q), from the logarithms of y and 1 - y."""
    small, large = np.minimum(p, q), np.maximum(p, q)
    plain = _log_gamma(p + q) - _log_gamma(large)
    at = np.maximum(large, 30.0)
    # log G(small + large) - log G(large), without the difference of two large numbers
    written = (
        (at - 0.5) * np.log1p(small / at) - small + small * np.log(at + small)
        + _series(at + small) - _series(at)
    )
    ratio = np.where(large >= 30.0, written, plain)
    return ratio - _log_gamma(small) + p * log_y + q * log_rest


def _fraction(p: np.ndarray, q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The continued fraction, for y below the mean."""
    c = np.ones_like(y)
    d = 1.0 - (p + q) * y / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    value = d.copy()
    for m in range(1, _TERMS):
        even = m * (q - m) * y / ((p + 2 * m - 1.0) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1.0))
        change = np.ones_like(y)
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            change = d * c
            value = value * change
        if np.all(np.abs(change - 1.0) < 1e-15):
            return value / p
    raise ArithmeticError("the continued fraction did not converge")


def _panels(a: np.ndarray, b: np.ndarray, x: np.ndarray, log_front: np.ndarray) -> np.ndarray:
    """I_x(a, b) above the mean for small x, by Gauss quadrature in panels from 0 to x.

    Far above the mean the density left out is below any double.
    """
    parts = 64
    share = ((np.arange(parts)[:, None] + 0.5 * (_NODES + 1)) / parts).reshape(-1)
    weight = np.tile(_WEIGHTS * 0.5 / parts, parts)
    logs = (a[:, None] - 1) * np.log(share) + (b[:, None] - 1) * np.log1p(-x[:, None] * share)
    logs += (log_front - b * np.log1p(-x))[:, None]
    inside = np.exp(logs) @ weight
    certain = x * (a + b) > a + 12 * np.sqrt(a) + 100
    return np.where(certain, 1.0, np.minimum(inside, 1.0))


def _quadrature(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) for large a and b, from the density around its mode."""
    a1, b1 = a - 1.0, b - 1.0
    n1 = a1 + b1
    mode, rest = a1 / n1, b1 / n1
    spread = np.sqrt(mode * rest / n1)
    lower = x <= mode
    far = np.where(
        lower,
        np.maximum(0.0, np.minimum(mode - 12 * spread, x - 6 * spread)),
        np.minimum(1.0, np.maximum(mode + 12 * spread, x + 6 * spread)),
    )
    half = 0.5 * np.abs(far - x)
    # distances from the mode, so that no digits are lost in sums with it
    away = (0.5 * (far + x) - mode)[:, None] + half[:, None] * _NODES
    with np.errstate(divide="ignore", invalid="ignore"):
        log_shape = a1[:, None] * np.log1p(away / mode[:, None]) + b1[:, None] * np.log1p(-away / rest[:, None])
    shape = np.exp(np.nan_to_num(log_shape, nan=-np.inf, neginf=-np.inf))
    log_top = np.log(n1 + 1) + 0.5 * np.log(n1 / (2 * pi * a1 * b1)) + _series(n1) - _series(a1) - _series(b1)
    tail = np.exp(log_top) * half * (shape @ _WEIGHTS)
    return np.clip(np.where(lower, tail, 1.0 - tail), 0.0, 1.0)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) for positive a and b and x in [0, 1]."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1.0, 1.0, 0.0)
    inside = (x > 0.0) & (x < 1.0)
    large = inside & (np.minimum(a, b) > LARGE)
    if large.any():
        out[large] = _quadrature(a[large], b[large], x[large])
    inside &= ~large
    if not inside.any():
        return out
    a, b, x = a[inside], b[inside], x[inside]
    mirrored = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(mirrored, b, a), np.where(mirrored, a, b)
    log_x, log_rest = np.log(x), np.log1p(-x)
    front = _log_front(p, q, np.where(mirrored, log_rest, log_x), np.where(mirrored, log_x, log_rest))
    # 1 - x would lose the digits of a small x among very many
    tiny = mirrored & (x < 1e-3) & (a >= 1.0)
    tail = np.zeros_like(x)
    rest = ~tiny
    if rest.any():
        y = np.where(mirrored, 1.0 - x, x)[rest]
        tail[rest] = np.exp(front[rest]) * _fraction(p[rest], q[rest], y)
    value = np.where(mirrored, 1.0 - tail, tail)
    if tiny.any():
        value[tiny] = _panels(a[tiny], b[tiny], x[tiny], front[tiny])
    out[inside] = value
    return out


def beta_quantile(level: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x with I_x(a, b) = level, by halving the interval."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(200):
        middle = 0.5 * (low + high)
        below = incomplete_beta(a, b, middle) < level
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return 0.5 * (low + high)


def interval_bounds(
    correct: np.ndarray, total: np.ndarray, alpha: float
) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.asarray(correct, dtype=float), np.asarray(total, dtype=float)
    low, high = np.zeros(len(k)), np.ones(len(k))
    some, not_all = k > 0, k < n
    low[some] = beta_quantile(alpha / 2, k[some], n[some] - k[some] + 1)
    high[not_all] = beta_quantile(1 - alpha / 2, k[not_all] + 1, n[not_all] - k[not_all])
    empty = n <= 0
    low[empty] = high[empty] = np.nan
    return low, high


def two_sided_p(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Exact two-sided sign test on the two discordant counts."""
    b, c = np.asarray(first, dtype=float), np.asarray(second, dtype=float)
    smaller, n = np.minimum(b, c), b + c
    out = np.ones(len(b))
    unequal = b != c
    # P(X <= k) for a fair coin is I_{1/2}(n - k, k + 1).
    out[unequal] = np.minimum(
        1.0,
        2.0
        * incomplete_beta(
            n[unequal] - smaller[unequal], smaller[unequal] + 1.0, np.full(unequal.sum(), 0.5)
        ),
    )
    return out


def exact_interval(correct: Column, total: Column, alpha: float = 0.05) -> Column:
    """Clopper-Pearson bounds as a struct; an empty group gives nulls."""

    @F.pandas_udf("lower double, upper double")
    def bounds(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        low, high = interval_bounds(k.to_numpy(), n.to_numpy(), alpha)
        return pd.DataFrame({"lower": low, "upper": high})

    return F.when(total > 0, bounds(correct.cast("double"), total.cast("double")))


def mcnemar_p(first_only: Column, second_only: Column) -> Column:
    @F.pandas_udf("double")
    def p_value(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(two_sided_p(b.to_numpy(), c.to_numpy()))

    return p_value(first_only.cast("double"), second_only.cast("double"))
