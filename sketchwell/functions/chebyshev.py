"""Chebyshev series of functions on [-1, 1], found by doubling the nodes until what they leave out is small.

A series is an array of coefficients, its last axis in the order of the polynomials, so that several
functions can be fitted, evaluated and integrated together. Nodes are cosines, from 1 down to -1.
"""

from __future__ import annotations

import numpy as np

TOLERANCE, FIRST, MOST = 1e-12, 32, 1 << 18


def nodes(n: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(n + 1) / n)


def coefficients(values: np.ndarray) -> np.ndarray:
    """The series through values at nodes(n): the cosine transform of their even continuation."""
    n = values.shape[-1] - 1
    out = np.fft.rfft(np.concatenate([values, values[..., -2:0:-1]], axis=-1), axis=-1).real / n
    out[..., [0, -1]] /= 2
    return out


def values(series: np.ndarray, n: int) -> np.ndarray:
    """A series of at most n + 1 coefficients at nodes(n)."""
    full = np.zeros((*series.shape[:-1], n + 1))
    full[..., : series.shape[-1]] = series
    full[..., [0, -1]] *= 2
    return np.fft.irfft(n * full, 2 * n, axis=-1)[..., : n + 1]


def left_out(series: np.ndarray) -> float:
    """The greatest of the last eighth of coefficients, as a share of the greatest of all; 1 for a function that no node has met."""
    size = np.abs(series)
    return float(size[..., -max(2, series.shape[-1] // 8) :].max() / size.max()) if size.max() > 0 else 1.0


def fit(f, tolerance: float = TOLERANCE, first: int = FIRST, most: int = MOST) -> tuple[np.ndarray, bool]:
    """(series, converged) of f, which takes an array and gives one or a stack of them: nodes double while left_out is above the tolerance."""
    n = first
    while True:
        series = coefficients(np.asarray(f(nodes(n)), float))
        if not np.isfinite(series).all() or (rest := left_out(series)) > tolerance and n * 2 > most:
            return series, False
        if rest <= tolerance:
            size = np.abs(series).reshape(-1, n + 1).max(axis=0)
            return series[..., : int(np.flatnonzero(size > tolerance * size.max())[-1]) + 1], True
        n *= 2


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The series of the product of two functions."""
    degree = a.shape[-1] + b.shape[-1] - 2
    n = max(1, degree)
    return coefficients(values(a, n) * values(b, n))[..., : degree + 1]


def multiply_by_basis(series: np.ndarray, k: int) -> np.ndarray:
    """The series times the k-th polynomial: half goes k places up, half k places down, where those below 0 turn back."""
    out = np.zeros((*series.shape[:-1], series.shape[-1] + k))
    place = np.arange(series.shape[-1])
    out[..., place + k] += series / 2
    np.add.at(out, (..., np.abs(place - k)), series / 2)
    return out


def integral(series: np.ndarray) -> np.ndarray:
    """The integral from -1 to 1."""
    even = np.arange(0, series.shape[-1], 2)
    return series[..., ::2] @ (2 / (1 - even**2.0))


def antiderivative(series: np.ndarray) -> np.ndarray:
    """The series of the integral from -1 up to a point."""
    low = np.concatenate([2 * series[..., :1], series[..., 1:]], axis=-1)
    high = np.zeros_like(low)
    high[..., :-2] = series[..., 2:]
    k = np.arange(1, series.shape[-1] + 1)
    rest = (low - high) / (2 * k)
    return np.concatenate([(rest * np.where(k % 2, 1.0, -1.0)).sum(axis=-1, keepdims=True), rest], axis=-1)


def weights(n: int) -> np.ndarray:
    """What values at nodes(n) weigh in the integral from -1 to 1 of the series through them."""
    k = np.arange(n + 1)
    even = np.where(k % 2 == 0, 2 / (1 - np.where(k % 2 == 0, k, 0) ** 2.0), 0.0) * 2 / n
    even[[0, -1]] /= 2
    out = values(even, n)
    out[[0, -1]] /= 2
    return out
