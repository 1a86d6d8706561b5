"""Hashes of word shingles and MinHash signatures, whole batches at a time in numpy.

A word is a run of ASCII digits, lower-cased letters and non-ASCII characters.
"""

from __future__ import annotations

import numpy as np

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 14)
        x = np.full(size, np.uint64(base), np.uint64)
        x[0] = 1
        _powers[base] = have = np.cumprod(x, dtype=np.uint64)
        if size > 1 << 20:  # a very long text's table isn't kept
            del _powers[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    b = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _WORD[b], [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(b)), out=total[1:])
    return mix((total[end] - total[begin]) * _power(_INVERSE, len(b))[begin] if len(begin) else np.zeros(0, np.uint64))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; fewer words form one shingle, no word none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(w))):
        total = total * np.uint64(0xD6E8FEB86659FD93) + w[k : k + n]
    return np.unique(mix(total))


def minhashes(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """(sets, permutations) minima; none of the sets may be empty."""
    generator = np.random.default_rng(20240607)
    times = generator.integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = generator.integers(0, 1 << 63, permutations, np.uint64)
    out = np.empty((len(sets), permutations), np.uint64)
    k = 0
    while k < len(sets):
        stop, size = k, 0
        while stop < len(sets) and (stop == k or size + len(sets[stop]) <= 1 << 14):
            size += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[k:stop])
        cuts = np.cumsum([0] + [len(x) for x in sets[k : stop - 1]])
        for p in range(permutations):
            out[k:stop, p] = np.minimum.reduceat((flat ^ plus[p]) * times[p], cuts)
        k = stop
    return out
