"""A keyed permutation of 0..n-1 that is computed index by index: a Feistel network with cycle walking."""

from __future__ import annotations

import numpy as np

ROUNDS = 6


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of SplitMix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_of(*parts) -> np.ndarray:
    """One 64-bit key from whole numbers or arrays of them."""
    key = np.zeros((), np.uint64)
    for part in parts:
        key = mix(key ^ np.asarray(part).astype(np.uint64))
    return key


def permute(index, n, key) -> np.ndarray:
    """The place of each ``index`` under the permutation of ``range(n)`` that ``key`` names; all three may be arrays."""
    index, n, key = np.broadcast_arrays(np.asarray(index, np.uint64), np.asarray(n, np.uint64), np.asarray(key, np.uint64))
    top, half = np.maximum(n, 2) - np.uint64(1), np.zeros(n.shape, np.uint64)
    for b in range(64):
        half += (top >> np.uint64(b)) > 0
    half = (half + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.copy(), np.flatnonzero(n > 0)
    while todo.size:
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right ^ mix(k ^ np.uint64(r))) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)
