"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
#: A random number for each byte, A-Z as a-z.
BYTE_HASH = _rng.integers(1, np.iinfo(np.int64).max, 256, dtype=np.int64).astype(np.uint64)
BYTE_HASH[65:91] = BYTE_HASH[97:123]
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """At least n + 1 powers of an odd base and of its inverse, modulo 2^64; kept for later calls."""
    if not _powers or len(_powers[0]) <= n:
        size, made = max(n + 1, 1 << 21), []
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            p = np.full(size, _U(base))
            p[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.cumprod(p))
        _powers[:] = made
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text); words are runs of other than blank bytes."""
    n = len(data)
    forth, back = powers(n)
    inside = ~WHITE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edges - 1
    ends[last] = inside[last]
    end = np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[data] * forth[:n])])
        words = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    return words, np.diff(np.searchsorted(start, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of distinct k-word shingles, ascending within a text; sizes of the sets).

    A text with fewer than k words has one shingle, its whole sequence; one without words none.
    """
    words, many = word_hashes(data, offsets)
    n = len(many)
    first = np.cumsum(many) - many
    count = np.where(many >= k, many - k + 1, (many > 0).astype(many.dtype))
    text = np.repeat(np.arange(n), count)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(many[text], k)
    with np.errstate(over="ignore"):
        value = np.zeros(len(text), np.uint64)
        for i in range(k):
            on = i < length
            step = mix(value * _U(0xD6E8FEB86659FD93) + words[np.minimum(at + i, max(0, len(words) - 1))]) if len(words) else value
            value = np.where(on, step, value)
    order = np.lexsort((value, text)) if n > 1 else np.argsort(value, kind="stable")
    text, value = text[order], value[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[keep], np.bincount(text[keep], minlength=n)
