"""Vectorised word and window hashing over UTF-8 buffers.

A word is a run of bytes other than space and 0x09-0x0D, so words are those of `[^\\x20\\x09-\\x0D]+`. Its hash is a
64-bit polynomial (Rabin-Karp) over a fixed random value for each byte, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
WINDOW_BASE = 0xD6E8FEB86659FD93 | 1
_BYTE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}
#: Bytes hashed at a time, which bounds the prefix sums held.
STEP = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 12)
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        with np.errstate(over="ignore"):
            got = np.cumprod(got, dtype=np.uint64)
        if size <= 4 * STEP:
            _powers[base] = got
    return got[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def spans(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[first:last], any number of spans, in ascending order."""
    n = len(values)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=total[1:])
        return (total[last] - total[first]) * powers(inverse(base), n + 1)[first]


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: first byte, byte after the last, and the row it is in."""
    full = ~_SPACE[data]
    if not len(full):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.empty(len(full), bool)
    before[0] = False
    before[1:] = full[:-1]
    first = np.flatnonzero(full & (~before | edge[:-1]))
    after = np.empty(len(full), bool)
    after[-1] = False
    after[:-1] = full[1:]
    last = np.flatnonzero(full & (~after | edge[1:])) + 1
    return first, last, np.searchsorted(starts, first, side="right") - 1


def hash_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; the spans ascend and don't overlap."""
    out = np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last, first[i] + STEP, side="right")))
        s, e = int(first[i]), int(last[j - 1])
        out[i:j] = spans(_BYTE[data[s:e]], first[i:j] - s, last[i:j] - s, BASE)
        i = j
    with np.errstate(over="ignore"):
        return mix(out + (last - first).astype(np.uint64) * U(0xA0761D6478BD642F))


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: hash, row, first byte, byte after the last."""
    first, last, row = word_spans(data, starts)
    return hash_spans(data, first, last), row, first, last


def windows(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every `size` consecutive words of one row, and the index of the first word of each."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out *= U(WINDOW_BASE)
            out += h[k : k + n]
    return mix(out[at]), at


def second_windows(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A second hash, of 32 bits, of the windows of `size` words that begin at `at`, independent of the first."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    low = (h ^ (h >> U(29))).astype(np.uint32)
    out = np.zeros(n, np.uint32)
    for k in range(size):
        out *= np.uint32(0x9E3779B1)
        out += low[k : k + n]
        out ^= out >> np.uint32(15)
    out = out[at]
    out *= np.uint32(0x85EBCA6B)
    return out ^ (out >> np.uint32(16))


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of `size` that begins at one of `at`: overlapping windows merge into intervals."""
    turns = np.zeros(n + 1, np.int32)
    np.add.at(turns, at, 1)
    np.add.at(turns, np.minimum(at + size, n), -1)
    return np.cumsum(turns[:-1]) > 0
