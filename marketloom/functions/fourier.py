"""Fourier coefficients of price windows as products with fixed kernels.

Detrending, odd extension, periodic cubic spline, Gaussian smoothing and the transform
are all linear, so the coefficients of all windows of a series are one matrix product
with a kernel that depends on the windows' length only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def periodic_spline(values: np.ndarray, factor: int) -> np.ndarray:
    """Cubic spline through rows whose first and last value agree, ``factor`` points a step."""
    n = values.shape[0] - 1
    system = 4 * np.eye(n) + np.roll(np.eye(n), 1, axis=1) + np.roll(np.eye(n), -1, axis=1)
    y = values[:n]
    second = np.linalg.solve(system, 6 * (np.roll(y, -1, axis=0) - 2 * y + np.roll(y, 1, axis=0)))
    at = np.arange(n * factor + 1) / factor
    k = np.minimum(at.astype(int), n - 1)
    t = (at - k)[:, None]
    a, b, ma, mb = y[k], y[(k + 1) % n], second[k], second[(k + 1) % n]
    return (1 - t) * a + t * b + ((1 - t) ** 3 - (1 - t)) * ma / 6 + (t**3 - t) * mb / 6


def smooth_wrapped(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing of each column, cut at four deviations, around the ends."""
    reach = int(4 * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight /= weight.sum()
    return sum(w * np.roll(values, k, axis=0) for w, k in zip(weight, range(-reach, reach + 1), strict=True))


def coefficients(samples: np.ndarray, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and sine coefficients of columns sampled at evenly spaced points from -pi on."""
    n = samples.shape[0]
    t = -np.pi + 2 * np.pi * np.arange(n) / n
    k = np.arange(n // 2 if count is None else count)[:, None]
    scale = np.where(k == 0, 1.0, 2.0) / n
    return scale * (np.cos(k * t) @ samples), scale * (np.sin(k * t) @ samples)


#: Windows that are worked on together, so that they stay in the cache.
BLOCK = 1024


@lru_cache(maxsize=64)
def kernels(size: int, factor: int = 8, cutoff: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of ``size`` values: cosine and sine kernels [cutoff, size], and the
    kernels [cutoff, size, size] that give the residual of the partial sums."""
    one = np.eye(size)
    x = np.arange(size) / (size - 1)
    line = np.outer(1 - x, one[0]) + np.outer(x, one[-1])
    flat = one - line
    odd = np.concatenate([flat, -flat[:-1][::-1]])
    fine = smooth_wrapped(periodic_spline(odd, factor), max(factor // 4, 1))
    cos, sin = coefficients(fine, cutoff)
    t = np.linspace(-np.pi, 0, size)
    parts = [np.outer(np.cos(k * t), cos[k]) + np.outer(np.sin(k * t), sin[k]) for k in range(cutoff)]
    residual = np.cumsum(np.stack(parts), axis=0) + line[None] - one[None]
    return cos, sin, residual


def window_features(values: np.ndarray, size: int, factor: int = 8, cutoff: int = 5) -> np.ndarray:
    """For each row, of the last ``size`` values: signs of the sine coefficients 1 to
    ``cutoff`` - 1, sizes of these coefficients, and the root mean squares of the residual
    of all partial sums and of the line alone.  NaN where a value is missing."""
    out = np.full((len(values), 2 * (cutoff - 1) + 2), np.nan)
    if len(values) < size:
        return out
    cos, sin, _ = kernels(size, factor, cutoff)
    window = np.lib.stride_tricks.sliding_window_view(values, size)
    at, t, order = np.arange(size) / (size - 1), np.linspace(-np.pi, 0, size), np.arange(cutoff)[:, None]
    # a line has no coefficients, so those of a window are those of its distance from its line, in one product
    # with the sum of that distance; a few functions make up for a kernel of size * size
    transform, functions = np.vstack([-cos, -sin, np.ones(size)]).T, np.vstack([np.cos(order * t), np.sin(order * t)])
    for a in range(0, len(window), BLOCK):
        w = window[a:a + BLOCK]
        line = np.outer(w[:, 0], 1 - at)
        line += np.outer(w[:, -1], at)
        line -= w
        found = line @ transform
        c0, total, square = found[:, 0], found[:, -1], np.einsum("ij,ij->i", line, line)
        line_square = np.maximum(square + c0 * (2 * total + size * c0), 0)
        line += found[:, :-1] @ functions
        c, s = found[:, 1:cutoff], found[:, cutoff + 1:-1]
        rms = np.sqrt(np.stack([np.einsum("ij,ij->i", line, line), line_square], axis=1) / size)
        out[a + size - 1:a + size - 1 + len(w)] = np.hstack([np.sign(s), np.hypot(c, s), rms])
    return out
