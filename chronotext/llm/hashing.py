"""Words of many texts at once as 64-bit numbers, by numpy over the UTF-8 bytes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. Numbers depend on the bytes alone, so they agree between tasks and runs. Two different
words or word sequences share one with a chance of 2**-64.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = _CODES.copy()
_LOWER[0x41:0x5B] = _CODES[0x61:0x7B]
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step & _MASK
    return out


class _Powers:
    """Powers of a base and of its inverse, kept as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words' bytes, and the number of the first word of each text."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, finish = ~space, ~space
    begin[1:] &= space[:-1] | edge[1:-1]
    finish[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A number for each word; ``lower`` takes A-Z as a-z."""
    codes, out, i = _LOWER if lower else _CODES, np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _PIECE)))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _BYTE_POWERS.get(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(codes[data[low:high]] * up[: high - low], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out)


def runs(words: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """A number for each run of words [low, high)."""
    up, down = _WORD_POWERS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[highs] - sums[lows]) * down[lows] + (highs - lows).astype(np.uint64))


def sequences(words: np.ndarray, k: int) -> np.ndarray:
    """A number for each k words in a row, over the ends of texts too (see ``inside``)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return runs(words, at, at + k)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """For each start in ``sequences(words, k)``, whether its k words are of one text."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    end = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= end
