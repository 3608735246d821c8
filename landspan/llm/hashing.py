"""Rolling 64-bit hashes of byte strings, computed for all positions at once.

A byte b at position i adds ``code[b] * B**-i`` to a running sum modulo 2**64; the
difference of two sums, times ``B**start``, is a hash that depends on the bytes only.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    size = 1
    while size < n:
        step = np.uint64(pow(base, size, 2**64))
        take = min(size, n - size)
        out[size:size + take] = out[:take] * step
        size += take
    return out


class Roller:
    """Hashes of substrings of one text; several rollers give independent hashes."""

    def __init__(self, seed: int = 1):
        self._base = pow(_MULTIPLIER, 2 * seed + 1, 2**64) | 1
        self._inverse = pow(self._base, -1, 2**64)
        self.code = np.random.default_rng(seed).integers(1, 2**63, 256, np.uint64)
        self._up = self._down = np.empty(0, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums of a uint8 array, one longer than the array."""
        n = len(data) + 1
        if len(self._up) < n:
            size = max(n, 2 * len(self._up), 1024)
            self._up, self._down = _powers(self._base, size), _powers(self._inverse, size)
        out = np.zeros(n, np.uint64)
        np.cumsum(self.code[data] * self._down[:n - 1], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end)."""
        return mix((sums[end] - sums[start]) * self._up[start])

    def grams(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all substrings of one width."""
        n = len(sums) - width
        return mix((sums[width:] - sums[:n]) * self._up[:n]) if n > 0 else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))
