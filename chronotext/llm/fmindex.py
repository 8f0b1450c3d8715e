"""A compressed FM-index over numbered words: wavelet matrix, backward search, matching statistics.

Searches run for many patterns at once, step by step, as numpy operations.
"""

from __future__ import annotations

import numpy as np

_ONE, _LOW = np.uint64(1), np.uint64(63)


class BitVector:
    """Bits packed in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each place."""
        word = at >> 6
        mask = (_ONE << (at.astype(np.uint64) & _LOW)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Occurrences of a symbol before a place, in one step for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = []
        for shift in range(max(int(largest).bit_length(), 1) - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, BitVector(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.begins = np.zeros(0, np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the place beside it, plus where its block begins."""
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at


def sort_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, by doubling."""
    n, span = len(symbols), 1
    ranks = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    while span < depth:
        following = np.zeros(n, np.int64)
        following[: max(n - span, 0)] = ranks[span:] + 1
        values, ranks = np.unique(ranks * (n + 2) + following, return_inverse=True)
        span *= 2
        if len(values) == n:
            break
    return np.argsort(ranks, kind="stable")


class FMIndex:
    """Index of texts of numbered words (from 1), each ended by a 0 that no pattern holds.

    Suffixes are ordered by ``depth`` words, which is exact for patterns of up to ``depth`` words.
    """

    def __init__(self, texts: np.ndarray, depth: int):
        order = sort_suffixes(texts, depth)
        last = texts[order - 1]  # the first text is preceded by the final 0
        largest = int(texts.max(initial=0))
        self.size = len(texts)
        self.tree = WaveletMatrix(last, largest)
        counts = np.bincount(texts, minlength=largest + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        symbols = np.arange(largest + 1)
        self.shift = self.first - self.tree.rank(symbols, np.zeros(largest + 1, np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that begin with the symbol before the pattern."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.shift[symbol]
        return both[: len(low)] + shift, both[len(low) :] + shift


def repeated_windows(index: FMIndex, texts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, suffix interval) of the windows that occur twice at least in the index.

    A window is the ``length`` words up to a place of ``ends`` in ``texts``, and its search goes back from there.
    Its matching statistic, the longest suffix of it that occurs elsewhere too, is the number of
    steps until one suffix is left; it is dropped then, and kept if it reaches ``length``.
    """
    alive = np.arange(len(ends))
    low, high = np.zeros(len(ends), np.int64), np.full(len(ends), index.size)
    for step in range(length):
        low, high = index.extend(texts[ends[alive] - 1 - step], low, high)
        more = high - low > 1
        alive, low, high = alive[more], low[more], high[more]
        if not len(alive):
            break
    return alive, low
