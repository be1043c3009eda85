"""Word and shingle hashes of whole texts as numpy arrays, for use inside tasks.

A word is a run of bytes outside space and \\t\\n\\v\\f\\r, so words of the UTF-8 bytes are the words of the text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 20
#: Of at most so many hashes all minima are taken in one call.
_NARROW = 1024
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of ``base`` modulo 2 ** 64, from the zeroth."""
    if n > len(_powers.get(base, ())):
        p = np.full(max(n, 1 << 14), base, np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(data, np.uint8)
    gap = np.ones(len(buf) + 2, np.int8)
    gap[1:-1] = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(gap)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(_BASE, len(buf) + 1), powers(_INVERSE, len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start, end


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word of ``data``, in order; equal words have equal hashes wherever they stand."""
    return word_spans(data)[0]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of ``data``, in order."""
    if len(data) <= _BLOCK:
        return _hashes(data)
    parts, at = [], 0
    while at < len(data):  # blocks end at white space, so no word is cut and working memory is bounded
        to = at + _BLOCK
        while to < len(data) and data[to] not in b" \t\n\v\f\r":
            to += 1
        h, start, end = _hashes(data[at:to])
        parts.append((h, start + at, end + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingle_hashes(w: np.ndarray, k: int = 5) -> np.ndarray:
    """One hash for each run of ``k`` of the word hashes ``w``, in order; fewer words give one of them all, none give none."""
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h += w[i : len(w) - n + 1 + i] * _STEP[i]
    return mix(h)


def shingles(data: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of ``data``."""
    return np.unique(shingle_hashes(word_hashes(data), k))


@lru_cache
def _coefficients(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, count, dtype=np.uint64)


def minhashes(hashes: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """Low 16 bits of ``count`` minimum hashes; ``hashes`` must not be empty."""
    a, b = _coefficients(count, seed)
    best = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(best, (hashes[i : i + 2048, None] * a + b).min(axis=0), out=best)
    return mix(best) & np.uint64(0xFFFF)


def minhash_ranges(hashes: np.ndarray, cuts: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """As ``minhashes``, a row for each range of ``hashes``; ``cuts`` has first and end of each, first before end, in order."""
    a, b = _coefficients(count, seed)
    safe = np.append(hashes, hashes[-1:])  # an end may stand one past the last
    out, each = np.empty((count, len(cuts) // 2), np.uint64), np.empty_like(safe)
    if len(safe) <= _NARROW:  # all at once, as calls then cost more than the work in them
        return mix(np.minimum.reduceat(safe * a[:, None] + b[:, None], cuts, axis=1)[:, ::2].T) & np.uint64(0xFFFF)
    for i in range(count):
        np.multiply(safe, a[i], out=each)
        each += b[i]
        out[i] = np.minimum.reduceat(each, cuts)[::2]
    return mix(out.T) & np.uint64(0xFFFF)
