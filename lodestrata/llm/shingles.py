"""Hashes of the words and of the five-word shingles of many texts at once.

Words are runs of anything but ASCII white space, with A-Z lowered. A word's hash is a
polynomial in its bytes modulo 2**64, mixed; differences of running sums give those of all
words of a batch together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
BATCH_BYTES = 2_000_000
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_Q = np.array([pow(0xD1342543DE82EF95, i, 2**64) for i in range(SHINGLE)], dtype=np.uint64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BATCH_BYTES + 1)
        for i, p in enumerate((_P, _P_INVERSE)):
            steps = np.full(size, p, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, size: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """Runs of texts (or binaries) of some two million bytes, or single longer ones."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1 + texts.offset)[texts.offset :]
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield texts.slice(at, to - at)
        at = to


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, at: text i has the words at[i]:at[i + 1]) of a string array without nulls."""
    if not len(texts):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    if lo == hi:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    b = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[lo:hi]
    offsets = offsets - lo
    n = len(b)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    last[ends_at] = inside[ends_at]
    ends = np.flatnonzero(last) + 1
    low = b + (((b >= 65) & (b <= 90)).view(np.uint8) << 5)
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word shingles; a shorter text that has words is one shingle."""
    for some in slices(texts):
        h, at = word_hashes(some)
        n = len(h) - SHINGLE + 1
        whole = np.zeros(max(n, 0), dtype=np.uint64)
        for j in range(SHINGLE if n > 0 else 0):
            whole += h[j : j + n] * _Q[j]
        whole = mix64(whole)
        for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
            if z - a >= SHINGLE:
                yield np.unique(whole[a : z - SHINGLE + 1])
            elif z > a:
                yield mix64((h[a:z] * _Q[: z - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(z - a))
            else:
                yield np.empty(0, np.uint64)


class MinHash:
    """n hash functions of 64-bit shingle hashes; a signature holds the least value of each, 32 bits."""

    def __init__(self, n: int = 128, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 2**32 - 1, dtype=np.uint32)
        for at in range(0, len(shingles), 1024):
            v = (shingles[at : at + 1024, None] * self.a + self.b) >> np.uint64(32)
            least = np.minimum(least, v.min(axis=0).astype(np.uint32))
        return least
