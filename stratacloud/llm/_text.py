"""Vectorised words, hashes and shingles over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
PIECE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20_240_611))
_BYTE, _BYTE_AGAIN = (_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    size = -(-max(n, 1) // PIECE_BYTES) * PIECE_BYTES
    if size not in _powers:
        if any(have >= n for have in _powers):
            return next(v for have, v in _powers.items() if have >= n)
        _powers.clear()
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


class Rolling:
    """Hashes of any slices of one byte buffer from prefix sums; equal slices hash equally wherever they lie.

    ``again`` gives hashes that are independent of the others.
    """

    def __init__(self, data: np.ndarray, again: bool = False):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE_AGAIN if again else _BYTE)[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every row, and per row the index of its first word (n+1 values)."""
    solid = ~_SPACE[data]
    first = np.ones(len(data) + 1, bool)
    first[1:-1] = ~solid[:-1]
    first[offs[:-1]] = True
    last = np.ones(len(data) + 1, bool)
    last[1:-1] = ~solid[1:]
    last[offs[1:]] = True
    starts = np.flatnonzero(solid & first[:-1])
    ends = np.flatnonzero(solid & last[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


_K = mix(np.arange(1, 6, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
SHINGLE_WORDS = 5


def shingles(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit fingerprints of its 5-word shingles.

    Fewer than five words make one shingle of them all; no words make none.
    """
    data = lower(data)
    starts, ends, at = words(data, offs)
    h = Rolling(data).of(starts, ends)
    if len(h) >= SHINGLE_WORDS:
        n = len(h) - SHINGLE_WORDS + 1
        five = h[:n] * _K[0]
        for j in range(1, SHINGLE_WORDS):
            five += h[j : n + j] * _K[j]
        five = mix(five)
    else:
        five = np.empty(0, np.uint64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE_WORDS:
            out.append(np.unique(five[a : b - SHINGLE_WORDS + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _K[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(five[:0])
    return out
