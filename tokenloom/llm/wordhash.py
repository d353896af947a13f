"""Rolling hashes of words and word n-grams, in numpy, for whole groups of texts at once.

A word is a run of bytes other than space and \\x09-\\x0D. Its hash is a
polynomial over its bytes modulo 2**64, cut out of one running sum per group of
texts, so no Python object is made for a word. The hash of an n-gram is a
second polynomial over word hashes, cut out of one running sum for every length.
Words and n-grams are told apart by these 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_KEPT_POWERS = 1 << 21
GROUP_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers_held: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers_held.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1024), base, dtype=U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= _KEPT_POWERS:
            _powers_held[base] = have
    return have[:n]


def _running(values: np.ndarray) -> np.ndarray:
    """Sums of value[i] * base**i over all i below each place."""
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * _powers(_BASE, len(values)), out=sums[1:])
    return sums


def ngram_hashes(sums: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; ``sums`` from ``running_words``."""
    count = len(sums) - n
    if count <= 0:
        return np.zeros(0, dtype=U64)
    return mix((sums[n:] - sums[:count]) * _powers(_INVERSE, count) + U64(n))


def running_words(words: np.ndarray) -> np.ndarray:
    return _running(words)


@dataclass
class Hashed:
    """Words of some consecutive texts: text t has words offsets[t]:offsets[t+1]."""

    first: int
    offsets: np.ndarray
    words: np.ndarray
    chars: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The text (from 0) of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def _hash_bytes(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and code point counts of the words in a byte array."""
    inside = np.empty(len(buf) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[buf]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    sums = _running(_BYTE[_LOWER[buf] if lower else buf])
    raw = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(buf) + 1)[starts]
    heads = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
    return starts, mix(raw + (ends - starts).astype(U64)), heads[ends] - heads[starts]


def _hash_long(data: bytes, lower: bool, group_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """A text above the group size, cut after white space; only words are cut out whole."""
    words, chars, at = [], [], 0
    while at < len(data):
        cut = min(at + group_bytes, len(data))
        while cut < len(data) and not _SPACE[data[cut]]:
            cut += 1
        _, w, c = _hash_bytes(np.frombuffer(data[at:cut], dtype=np.uint8), lower)
        words.append(w)
        chars.append(c)
        at = cut
    return np.concatenate(words), np.concatenate(chars)


def hashed_groups(texts: Sequence[bytes], lower: bool, group_bytes: int = GROUP_BYTES) -> Iterator[Hashed]:
    """Words of all texts, in groups of about ``group_bytes`` (a longer text is its own group)."""
    at = 0
    while at < len(texts):
        size, end = len(texts[at]) + 1, at + 1
        if size > group_bytes:
            words, chars = _hash_long(texts[at], lower, group_bytes)
            yield Hashed(at, np.array([0, len(words)]), words, chars)
        else:
            while end < len(texts) and size + len(texts[end]) + 1 <= group_bytes:
                size += len(texts[end]) + 1
                end += 1
            buf = np.frombuffer(b" ".join(texts[at:end]), dtype=np.uint8)
            starts, words, chars = _hash_bytes(buf, lower)
            borders = np.cumsum([0, *(len(t) + 1 for t in texts[at:end])])
            yield Hashed(at, np.searchsorted(starts, borders), words, chars)
        at = end
