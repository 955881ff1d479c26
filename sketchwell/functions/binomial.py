"""Exact limits of a share from a sample: quantiles of the beta distribution, in numpy over many groups."""

from __future__ import annotations

from math import lgamma

import numpy as np

_LOG_GAMMA = np.vectorize(lgamma, otypes=[float])
TERMS, HALVINGS = 400, 60


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by modified Lentz steps on all entries at once."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, TERMS):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + term * d), safe(1 + term / c)
            out = out * c * d
        if np.all(np.abs(c * d - 1) < 1e-13):
            break
    return out


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of a beta distribution (a, b) below x."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    flip = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    inner = np.clip(y, 1e-300, 1 - 1e-16)
    front = np.exp(p * np.log(inner) + q * np.log1p(-inner) + _LOG_GAMMA(p + q) - _LOG_GAMMA(p) - _LOG_GAMMA(q)) / p
    share = np.where(y <= 0, 0.0, front * _fraction(inner, p, q))
    return np.where(flip, 1 - share, share)


def beta_quantile(share: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.zeros(np.broadcast(a, b).shape), np.ones(np.broadcast(a, b).shape)
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        below = incomplete_beta(mid, a, b) < share
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def limits(hits: np.ndarray, n: np.ndarray, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest share under which so few or many hits among n have a probability of miss / 2 on each side."""
    hits, n = np.asarray(hits, float), np.asarray(n, float)
    lo = np.where(hits > 0, beta_quantile(miss / 2, np.maximum(hits, 1), n - hits + 1), 0.0)
    hi = np.where(hits < n, beta_quantile(1 - miss / 2, hits + 1, np.maximum(n - hits, 1)), 1.0)
    return lo, hi
