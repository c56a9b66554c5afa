"""Vectorised word and shingle hashing over UTF-8 bytes.

Words are maximal runs of bytes other than space and TAB..CR after lowering
``A``-``Z``; a document's shingles are its runs of ``k`` words, or the whole
word sequence as one shingle when it has fewer words. A text without words
(or null) has none. Equal shingles get equal 64-bit values; different ones
collide with a chance of about 2**-64 per pair.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 2**64)
_C = U(0xD6E8FEB86659FD93)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``p**i`` and ``p**-i`` modulo 2**64 for i < n, kept between calls."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for slot, base in ((0, _P), (1, _PINV)):
            steps = np.full(size, U(base), np.uint64)
            steps[0] = 1
            _POWERS[slot] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, shifted back, hash any byte range."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(len(buf))[0], out=out[1:])
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, each followed by a line feed, and the start of each (and the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), starts


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    white = _WHITE[buf]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(buf) and not white[0]:
        edge = np.concatenate(([0], edge))
    if len(buf) and not white[-1]:
        edge = np.concatenate((edge, [len(buf)]))
    return edge[0::2], edge[1::2]


def word_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = prefix_sums(buf)
    return mix((sums[end] - sums[begin]) * powers(len(buf) + 1)[1][begin] + (end - begin).astype(np.uint64) * _C)


def shingle_hashes(texts: list[bytes], k: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of each text in order: flat hashes, and each text's start (and the end)."""
    buf, starts = joined(texts)
    if lower:
        buf = LOWER[buf]
    begin, end = word_spans(buf)
    words = word_hashes(buf, begin, end)
    first = np.searchsorted(begin, starts)           # each text's first word
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(made, out=offsets[1:])
    out = np.empty(offsets[-1], np.uint64)
    if len(words) >= k:
        n = len(words) - k + 1
        h = words[:n].copy()
        for j in range(1, k):
            h = h * _C + words[j:j + n]
        # shingle i (by first word) goes to its text's place; those that cross texts are left out
        owner = np.repeat(np.arange(len(texts)), counts)[:n]
        fits = (np.arange(n) + k) <= first[owner + 1]
        out[(np.arange(n) - first[owner] + offsets[owner])[fits]] = mix(h[fits])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        h = np.array([int(counts[i])], np.uint64) * U(_P)
        for w in words[first[i]:first[i + 1]]:
            h = h * _C + w
        out[offsets[i]] = mix(h)[0]
    return out, offsets


def distinct_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    flat, offsets = shingle_hashes(texts, k)
    return [np.unique(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
