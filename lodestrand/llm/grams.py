"""Distinct character n-grams of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mix of 64-bit numbers."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie within a text, with offsets; three characters fit into 63 bits and stay exact."""
    if len(data) < n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    wide = data.astype(np.uint64)
    last = len(data) - n + 1
    if n <= 3:
        h = wide[:last].copy()
        for j in range(1, n):
            h = (h << np.uint64(21)) | wide[j : j + last]
    else:
        h = wide[:last] + np.uint64(1)
        for j in range(1, n):
            h = h * MIX + wide[j : j + last] + np.uint64(1)
        h = mixed(h)
    lengths = np.maximum(np.diff(offsets) - (n - 1), 0)
    keep = np.zeros(len(data) + 1, np.int8)
    full = lengths > 0
    np.add.at(keep, offsets[:-1][full], 1)
    np.add.at(keep, offsets[:-1][full] + lengths[full], -1)
    return h[np.cumsum(keep)[:last] > 0], np.concatenate([[0], np.cumsum(lengths)])


def distinct_grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text, sorted within it, with offsets."""
    h, at = grams(data, offsets, n)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    return h, np.searchsorted(owner, np.arange(len(at)))
