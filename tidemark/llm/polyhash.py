"""Vectorised 64-bit hashing of byte strings inside tasks."""

from __future__ import annotations

import numpy as np

#: An odd base and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_up, _down = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    global _up, _down
    if len(_up) < n:
        size = max(n, 2 * len(_up))
        _up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, BASE))])
        _down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, INVERSE))])
    return _up[:n], _down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = sum of (data[k] + 1) * BASE**-k over i <= k < j, so that substrings compare by two look-ups."""
    _, down = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:-1], out=out[1:])
    return out


def substring_hashes(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever the substring stands."""
    up, _ = powers(len(s))
    return (s[end] - s[start]) * up[start]
