"""Tail probabilities in numpy, as no statistics library is at hand on executors."""

from __future__ import annotations

import math

import numpy as np


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)], out[ok & (x == 1)] = 0.0, 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        p, q, z = a[mid], b[mid], x[mid]
        swap = z > (p + 1) / (p + q + 2)
        p, q, z = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - z, z)
        lg = np.vectorize(math.lgamma)
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
        h = d.copy()
        for m in range(1, 400):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h *= c * d
            if np.all(np.abs(c * d - 1) < 1e-14):
                break
        value = front * h
        out[mid] = np.where(swap, 1 - value, value)
    return out


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|)"""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def t_critical(alpha: float, df: float) -> float:
    """t with P(|T| >= t) = alpha, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > alpha:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > alpha else (low, mid)
    return (low + high) / 2


def normal_scores(x: np.ndarray) -> np.ndarray:
    """Each column's values replaced by the normal quantiles of their (mean) ranks."""
    from statistics import NormalDist

    x = np.asarray(x, float)
    out = np.empty_like(x)
    n, quantile = len(x), NormalDist().inv_cdf
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        ranks = np.empty(n)
        ranks[order] = np.arange(1, n + 1)
        values, where = np.unique(x[:, j], return_inverse=True)
        mean = np.bincount(where, ranks) / np.bincount(where)
        del values
        out[:, j] = [quantile(r / (n + 1)) for r in mean[where]]
    return out
