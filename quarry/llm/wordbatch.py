"""Words of many texts at once, in numpy: bounds, owners and 64-bit hashes.

A word is a run of bytes other than space and \\x09-\\x0D; A-Z count as a-z.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multiplier of the polynomial hash; its powers are made from it on demand.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
CHUNK, LONG = 1 << 18, 1 << 12


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ordered_set(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by one sort."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


@dataclass
class Words:
    """Words of a batch in order; ``data`` holds all texts, lower-cased, each followed by a space."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    texts: int

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.start, self.end)

    def per_text(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.texts)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of non-empty byte spans that are in order and do not overlap.

    Spans are taken about CHUNK bytes at a time, so that a very long text needs few bytes
    beside its own; a span longer than LONG has the hash of its digest's bytes.
    """
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    length = end - start
    short = np.minimum(length, LONG)
    total = np.cumsum(short)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(total, total[first] - short[first] + CHUNK, side="right")))
        part = slice(first, last)
        size = short[part]
        offset = np.cumsum(size) - size
        at = np.arange(int(size.sum()))
        at -= np.repeat(offset, size)
        place = np.repeat(start[part], size)
        place += at
        values = data[place].astype(np.uint64)
        del place
        values += np.uint64(1)
        values *= _powers(int(size.max()))[at]
        del at
        out[part] = mix(np.add.reduceat(values, offset) + length[part].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = last
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def split(texts: list[bytes], lower: bool = True) -> Words:
    """Splits every text into words."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    gap = _SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    start = np.flatnonzero(before & ~gap)
    end = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    owner = np.searchsorted(np.cumsum(lengths), start, side="right")
    return Words(data, start, end, owner, len(texts))
