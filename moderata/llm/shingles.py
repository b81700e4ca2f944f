"""Sets of hashed word shingles, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_PRIME = 0x100000001B3


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1024), _PRIME, np.uint64)]))
    return _POWERS[:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text); A-Z count as a-z, words end at ASCII white space."""
    data = "\n".join(texts).encode("utf-8")
    raw = np.frombuffer(data + b"\n", np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.append(0, edge)
    start, end = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t.encode("utf-8")) if not t.isascii() else len(t) for t in texts), np.int64, len(texts))
    stops = np.cumsum(lengths + 1)
    counts = np.diff(np.append(0, np.searchsorted(start, stops)))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    size = end - start
    # Polynomial over the bytes from the word's end: the same word gives the same sum.
    flat_end = np.repeat(end, size)
    at = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    exponent = flat_end - at - 1
    terms = (_LOWER[raw[at]].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()) + 1)[exponent]
    return mix(np.add.reduceat(terms, np.cumsum(size) - size) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), counts


def shingle_sets(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct k-word shingles of every text, ascending within it; size of each set).

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    words, counts = word_hashes(texts)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    shingles = np.maximum(counts - k + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = np.arange(int(shingles.sum())) + np.repeat(first - (np.cumsum(shingles) - shingles), shingles)
    span = np.repeat(np.minimum(counts, k), shingles)
    value = np.zeros(len(at), np.uint64)
    for i in range(k):
        inside = span > i
        step = words[np.minimum(at + i, len(words) - 1)]
        value = np.where(inside, mix(value * np.uint64(3) + step + np.uint64(i)), value)
    owner = np.repeat(np.arange(len(texts)), shingles)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
    return value[fresh], np.bincount(owner[fresh], minlength=len(texts))
