"""Minima of sliding windows over arrays of hashes."""

from __future__ import annotations

import numpy as np


def window_minima(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest value of each window of ``width``, and the place of its first occurrence.

    Minima of windows of doubling width are combined, so the cost is that of
    ``log2(width)`` passes over the array.
    """
    n = len(values) - width + 1
    if n <= 0:
        return values[:0], np.zeros(0, np.int64)
    least, where, reach = values, np.arange(len(values)), 1
    while 2 * reach <= width:
        least, where = _first(least[:-reach], where[:-reach], least[reach:], where[reach:])
        reach *= 2
    if reach < width:
        shift = width - reach
        least, where = _first(least[:n], where[:n], least[shift : shift + n], where[shift : shift + n])
    return least[:n], where[:n]


def _first(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = a <= b
    return np.where(keep, a, b), np.where(keep, i, j)
