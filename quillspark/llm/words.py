"""Words of whole texts as 64-bit fingerprints, computed for many documents at once.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D), so of
characters `[^\\x20\\x09-\\x0D]`: UTF-8 continuation bytes are never white space.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

P = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
P_INVERSE = np.uint64(pow(int(P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keys(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * P + np.uint64(seed)) | np.uint64(1)


_BYTE = {s: keys(256, s) for s in (1, 2)}
_PLACE = {s: keys(1 << 12, 100 + s) for s in (1, 2)}
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        have = _POWERS[int(base)] = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the index of the first word of each row (with the total at the end)."""
    word = ~_SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[:1] = word[:1]
    edge[1:-1] = word[1:] & ~word[:-1]
    edge[-1] = False
    inner = offsets[:-1]
    inner = inner[inner < len(data)]
    edge[inner] = word[inner]
    starts = np.flatnonzero(edge[:-1]) if len(data) else np.zeros(0, np.int64)
    if len(starts) == 0:
        return starts, starts, np.zeros(len(offsets), np.int64)
    stop = ~word
    stop_at = np.flatnonzero(stop)
    nearest = np.searchsorted(stop_at, starts)
    ends = np.append(stop_at, len(data))[nearest]
    first = np.searchsorted(starts, offsets)
    ends = np.minimum(ends, np.repeat(offsets[1:], np.diff(first)))
    return starts, ends, first


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 1) -> np.ndarray:
    """A 64-bit fingerprint of each word: a multilinear hash of its bytes, then mix()."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    if lower:
        data = _LOWER[data]
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(before, lengths)
    at = place + np.repeat(starts, lengths)
    longest = int(lengths.max())
    place_keys = _PLACE[seed] if longest <= len(_PLACE[seed]) else keys(longest, 100 + seed)
    terms = _BYTE[seed][data[at]] * place_keys[place]
    return mix(np.add.reduceat(terms, before) + lengths.astype(np.uint64) * P)


def windows(fp: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive fingerprints; the caller leaves out those that cross rows."""
    n = len(fp) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(fp) + 1, np.uint64)
    np.cumsum(fp * _powers(P, len(fp)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers(P_INVERSE, n))


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k words that lie within one row."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(before, counts) + np.repeat(first[:-1], counts)


def cover(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in one of the windows of k words that begin at starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + k, n), -1)
    return np.cumsum(change[:-1]) > 0
