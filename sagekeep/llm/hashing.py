"""Rolling hashes and sliding minima over whole arrays."""

from __future__ import annotations

import numpy as np

MIX_A, MIX_B, MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB), np.uint64(0xBF58476D1CE4E5B9)
SHIFT = np.uint64(31)


def gram_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` code points at each position, by doubling."""
    power = (codes.astype(np.uint64) + np.uint64(1)) * MIX_C
    power ^= power >> SHIFT
    whole, done, size = None, 0, 1
    while True:
        if length & size:
            if whole is None:
                whole, done = power, size
            else:
                n = max(0, len(power) - done)
                whole = whole[:n] * MIX_A + power[done : done + n]
                whole ^= whole >> SHIFT
                done += size
        if size * 2 > length:
            return whole[: max(0, len(codes) - length + 1)]
        n = max(0, len(power) - size)
        power = power[:n] * MIX_B + power[size : size + n]
        power ^= power >> SHIFT
        size *= 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    count, size = len(values) - width + 1, 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:count], values[width - size : width - size + count])
