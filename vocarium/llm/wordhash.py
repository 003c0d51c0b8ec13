"""Vectorised words: boundaries and 64-bit hashes straight from UTF-8 bytes, no string per word."""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C55)
_RINV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words [^\x20\x09-\x0D]+
BLANK_WORDS = np.ones(256, bool)
BLANK_WORDS[[32, 9, 10, 11, 12, 13]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, r in enumerate((_R, _RINV)):
            x = np.full(size, r, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end]; a polynomial in an odd base, by prefix sums, then mixed."""
    up, down = _pow(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    v = values.astype(np.uint64)
    v += np.uint64(1)
    v *= up[: len(values)]
    np.cumsum(v, out=sums[1:])
    h = sums[ends] - sums[starts]
    h *= down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends, and for each text (and the end) its first word's number."""
    low = LOWER[buf]
    inside = keep[low]
    n = len(buf)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    final = inside.copy()
    final[:-1] &= ~inside[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begin[inner] = inside[inner]
    final[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(final) + 1
    return low, starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray = BLANK_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text (and the end) its first word's number."""
    low, s, e, first = words(buf, offs, keep)
    return span_hashes(low, s, e), first


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one text; of the whole sequence where it is shorter; none without words."""
    if not len(h):
        return h[:0]
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k])
    return out
