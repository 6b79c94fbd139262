"""Order statistics over ranges of a series, for all rows at once: n log n steps of whole arrays, however long the ranges."""

from __future__ import annotations

import numpy as np


def dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order (NaN last) and each value's place among them."""
    distinct, place = np.unique(values, return_inverse=True)
    return distinct, place.reshape(-1).astype(np.int64)


def kth(place: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each query the k-th smallest (from 0) of ``place[a:b]``, 0 <= k < b - a: a wavelet matrix, walked level by level as it is built."""
    a, b, k = a.copy(), b.copy(), k.copy()
    out = np.zeros(len(a), np.int64)
    for bit in range(int(place.max(initial=0)).bit_length() - 1, -1, -1):
        ones = (place >> bit & 1).astype(bool)
        zeros_before = np.concatenate([[0], np.cumsum(~ones)])
        za, zb = zeros_before[a], zeros_before[b]
        right = k >= zb - za
        k = np.where(right, k - (zb - za), k)
        a, b = np.where(right, zeros_before[-1] + a - za, za), np.where(right, zeros_before[-1] + b - zb, zb)
        out |= right.astype(np.int64) << bit
        place = np.concatenate([place[~ones], place[ones]])
    return out


def largest(place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each query the largest of ``place[a:b]``, a < b: two overlapping powers of two cover a range."""
    out = np.zeros(len(a), np.int64)
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    top, width = place, 1
    for k in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.maximum(top[a[own]], top[b[own] - width])
        top, width = np.maximum(top[: len(top) - width], top[width:]), 2 * width
    return out


def medians(values: np.ndarray, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Median of ``values[a:b]`` for each query, without the value at ``own`` (inside) if given; NaN where nothing is left."""
    n = b - a - (0 if own is None else 1)
    out = np.full(len(a), np.nan)
    some = np.flatnonzero(n > 0)
    if not len(some):
        return out
    distinct, place = dense(values)
    a, b, n = a[some], b[some], n[some]
    low, high = (n - 1) // 2, n // 2
    if own is None:
        first, second = kth(place, a, b, low), kth(place, a, b, high)
    else:  # without one value, what is not below it moves one rank down
        mine = place[own[some]]
        first, second, third = (kth(place, a, b, np.minimum(low + k, b - a - 1)) for k in range(3))
        first, second = np.where(first < mine, first, second), np.where(second < mine, second, third)
        second = np.where(high > low, second, first)
    out[some] = 0.5 * distinct[first] + 0.5 * distinct[second]
    return out
