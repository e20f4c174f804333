"""Content-chosen positions of a byte string: equal strings choose equal positions.

In every run of `length` bytes the `GRAM`-byte piece with the smallest hash is an anchor (the leftmost
of equal ones). Two equal runs hence choose the same piece at the same place, wherever they lie, so equal
runs can be found by bringing equal anchors together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

GRAM = 24
#: Bytes hashed at once: small enough for a processor's cache, and a bound on the memory of a task.
SLAB = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)


@cache
def _tables() -> np.ndarray:
    """A random number for each byte value."""
    return np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


class Hashed:
    """Hashes of any piece of `data`, each in constant time; equal pieces have equal hashes."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        room = 1 << max(20, (self.size + 1).bit_length())
        up, self.down = _powers(room)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(_tables()[data] * up[: self.size], out=self.sums[1:])

    def pieces(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, width: int) -> np.ndarray:
        """The hash of the `width` bytes at each place."""
        n = max(0, self.size - width + 1)
        return _mixed((self.sums[width : width + n] - self.sums[:n]) * self.down[:n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbouring keys."""
    reach, low = 1, keys
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def owned(hashed: Hashed, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The anchors of the texts that end at `ends` in the data (under 16 MB): hash and place, and first and
    last start of the runs that own it. A place comes twice if runs between those own another."""
    hashes = hashed.grams(GRAM)
    if hashed.size < length:
        return hashes[:0], *(np.zeros(0, np.int64),) * 3
    keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    low = _smallest(keys, length - GRAM + 1)
    open_ = np.ones(len(low), bool)  # runs that don't cross the end of a text
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        open_[max(start, end - length + 1) : end] = False
    runs = np.flatnonzero(open_)
    low = low[runs]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(low)), bool), low[1:] != low[:-1]]))
    at = (low[first] & _PLACE).astype(np.int64)
    return hashes[at], at, runs[first], runs[np.concatenate([first[1:], [len(runs)]])[: len(first)] - 1]


def slabs(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Cuts texts into lists of (index, offset, piece) of about `SLAB` bytes; pieces of one text overlap so
    that each run of `length` bytes lies in one of them."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SLAB):
            piece = text[at : at + SLAB + length - 1] if len(text) > SLAB else text
            held.append((k, at, piece))
            size += len(piece)
            if size >= SLAB:
                yield held
                held, size = [], 0
    if held:
        yield held
