"""Word shingles of whole texts as sorted arrays of 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of x over all 64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes that are hashed at once, up to the next white space.
_PIECE = 1 << 19


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, number of words of each text).

    A word's hash is the sum of a well mixed value for each of its bytes at its place, mixed once more with its length:
    a few passes of numpy, without any table of words.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    text_end = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    found, begins = [], []
    lo = 0
    while lo < len(data):
        hi = min(lo + _PIECE, len(data))
        while hi < len(data) and not _SPACE[data[hi - 1]]:
            ahead = _SPACE[data[hi : hi + _PIECE]]
            hi += int(ahead.argmax()) + 1 if ahead.any() else len(ahead)
        part = data[lo:hi]
        at = np.flatnonzero(~_SPACE[part])
        if len(at):
            first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # of each word, in at
            size = np.diff(first, append=len(at))
            place = at - np.repeat(at[first], size)
            with np.errstate(over="ignore"):
                values = mix64((_LOWER[part[at]].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1)) * _M1)
                found.append(mix64(np.add.reduceat(values, first) + size.astype(np.uint64) * _M3))
            begins.append(at[first] + lo)
        lo = hi
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(raw), np.int64)
    counts = np.diff(np.searchsorted(np.concatenate(begins), text_end), prepend=0)
    return np.concatenate(found), counts.astype(np.int64)


def shingle_sets(texts: Iterable[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): text i has the sorted distinct hashes[ends[i-1]:ends[i]].

    Fewer than k words: the whole sequence is the one shingle; none: the set is empty. Two different shingles share a
    64-bit hash with a chance of 2^-64 a pair.
    """
    h, n = word_hashes(texts)
    starts = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(h), np.uint64)
        at = np.arange(len(h))
        last = np.repeat(starts + n, n)
        size = np.minimum(n, k)[owner]
        for j in range(k):
            inside = at + j < last
            acc[inside] = mix64(acc[inside] * _M1 + h[at[inside] + j] + np.uint64(j + 1))
        first = at < np.repeat(starts + np.maximum(n - k + 1, np.minimum(n, 1)), n)
        acc = mix64(acc + size.astype(np.uint64))[first]
    owner = owner[first]
    edges = np.append(0, np.cumsum(np.bincount(owner, minlength=len(n)))).tolist()
    for lo, hi in zip(edges, edges[1:], strict=False):
        acc[lo:hi].sort()
    fresh = np.ones(len(acc), bool)
    fresh[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    acc, owner = acc[fresh], owner[fresh]
    return acc, np.cumsum(np.bincount(owner, minlength=len(n)))


def set_keys(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set (int64): equal sets have equal keys; 0 only for the empty set."""
    sizes = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(ends)), sizes)
    key = np.zeros(len(ends), np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(key, owner, mix64(hashes + _M1))
        key = mix64(key + sizes.astype(np.uint64) * _M3)
    key[(sizes > 0) & (key == 0)] = 1
    key[sizes == 0] = 0
    return key.view(np.int64)
