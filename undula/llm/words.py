"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which are white space in every UTF-8 text and no part of a longer character.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers of two independent polynomial hashes modulo 2**64 (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    bits = max(16, int(n).bit_length())
    return _powers(base, bits) if bits <= 21 else _powers.__wrapped__(base, bits)


class Words:
    """The words of a list of texts (bytes). Word i spans buf[start[i]:end[i]]; text d has words at[d]:at[d+1]."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined, dtype=np.uint8)
        self.joined = joined
        space = _SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]  # the last byte is white space
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.begin = begin
        self.at = np.searchsorted(self.start, begin)
        self.counts = np.diff(self.at)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes, about a megabyte of them at a time."""
        out = np.empty(len(self), dtype=np.uint64)
        at = 0
        while at < len(self):
            base = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.start, base + _CHUNK)))
            start, end = self.start[at:to] - base, self.end[at:to] - base
            size = np.diff(np.append(start, end[-1]))
            offset = np.arange(end[-1], dtype=np.int32) - np.repeat(start.astype(np.int32), size)
            terms = (self.buf[base : base + end[-1]].astype(np.uint64) + np.uint64(1)) * powers(BASES[which], int(size.max()))[0][offset]
            terms = np.append(terms, np.uint64(0))
            out[at:to] = np.add.reduceat(terms, np.stack((start, end), axis=1).ravel())[::2]
            at = to
        return mix(out + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.joined[self.start[i] : self.end[i]]

    def inside(self, n: int) -> np.ndarray:
        """For each word, whether n words from it on lie in its own text."""
        left = np.repeat(self.at[1:], self.counts) - np.arange(len(self))
        return left >= n


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word hashes, one for each start; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    base = BASES[0] ^ 0x5555555555555554
    up, down = powers(base, len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    m = len(h) - n + 1
    return mix((total[n:] - total[:m]) * down[:m])
