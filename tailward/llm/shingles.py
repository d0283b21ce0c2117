"""Word shingles of whole texts as numbers, computed for many rows at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .flat import flat, slices

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64, from 0 to ``n``."""
    if base not in _powers or len(_powers[base]) <= n:
        factors = np.full(max(n + 1, 1 << 18), base, np.uint64)
        factors[0] = 1
        powers = np.multiply.accumulate(factors)
        if n >= 1 << 24:
            return powers
        _powers[base] = powers
    return _powers[base]


_INVERSE = pow(_BASE, -1, 1 << 64)


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, and how many words stand before each row's edge."""
    inner = ~_SPACE[data]
    begins, ends = inner.copy(), inner.copy()
    starts = edges[:-1][edges[:-1] < len(data)]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    begins[1:] &= ~inner[:-1] | cut[1:-1]
    begins[starts] = inner[starts]
    ends[:-1] &= ~inner[1:] | cut[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n)[:n], out=total[1:])
    words = mix((total[last] - total[first]) * _power(_INVERSE, n)[first])
    return words, np.searchsorted(first, edges)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Each row's distinct shingles, sorted; a row of fewer words has its whole sequence as one."""
    data, at = flat(texts)
    for first, last in slices(at, 1 << 17):
        edges = at[first : last + 1] - at[first]
        words, before = _words(_LOWER[data[at[first] : at[last]]], edges)
        whole = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for k in range(width):
            whole = whole * _STEP + words[k : k + len(whole)]
        whole = mix(whole)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif a == b:
                yield np.zeros(0, np.uint64)
            else:
                one = np.zeros(1, np.uint64)
                for w in words[a:b]:
                    one = one * _STEP + w
                yield mix(one + np.uint64(b - a))
