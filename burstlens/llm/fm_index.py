"""Substring dedup over words: backward search in the FM-index of a shard.

A shard is a bucket of contexts that share anchors. Its index is the Burrows-Wheeler transform
of the word numbers in a wavelet tree stored by levels: packed bits with a count every 64, so
that the rank of a symbol costs one lookup per level. The contexts are streamed against it: a
window is searched from its last word to its first, all windows side by side; the number of
words after which only the window itself is left is its matching statistic, and windows that
reach the threshold with company are reported with their interval.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from burstlens.llm.repeats import WordUnits, remove_repeats
from burstlens.llm.suffix_merge import rotations

WIDTH = 20
GRAM = 8


class RankBits:
    """Bits, packed, with the number of ones before every 64th."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before place ``i``."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Ranks over a large alphabet; each level sorts by one bit, high bits first."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n_levels = max(1, int(n_symbols - 1).bit_length())
        self.levels = []
        for level in range(self.n_levels - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(np.uint8)
            self.levels.append(RankBits(bits))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        every = np.arange(n_symbols)
        self.begin = self._descend(every, np.zeros(n_symbols, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.n_levels - 1, -1, -1), self.levels, strict=True):
            ones = bits.ones(i)
            i = np.where((symbol >> level) & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place ``i``."""
        return self._descend(symbol, i) - self.begin[symbol]


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        order = rotations(symbols)
        self.tree = WaveletTree(symbols[order - 1], n_symbols)
        counts = np.bincount(symbols, minlength=n_symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])

    def search(self, symbols: np.ndarray, last: np.ndarray, width: int) -> tuple:
        """Matching statistic (up to ``width``) and interval of the strings that end at ``last``.

        Strings that only occur once are given up; their statistic is what they reached.
        """
        final = symbols[last]
        lo, hi = self.first[final], self.first[final + 1]
        reached = np.ones(len(last), np.int64)
        active = np.flatnonzero(hi - lo > 1)
        for step in range(1, width):
            if not len(active):
                break
            c = symbols[last[active] - step]
            lo[active] = self.first[c] + self.tree.rank(c, lo[active])
            hi[active] = self.first[c] + self.tree.rank(c, hi[active])
            active = active[hi[active] - lo[active] > 1]
            reached[active] = step + 1
        return reached, lo, hi


def repeated_windows(texts: list, owned: np.ndarray, order: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Which of the windows at the first ``owned`` places of each text also occur earlier."""
    lengths = np.array([len(t) for t in texts], np.int64)
    known, number = np.unique(np.concatenate(texts), return_inverse=True)
    n_symbols = len(known) + 2
    symbols = np.full(int(lengths.sum()) + len(texts) + 1, n_symbols - 2, np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    inside = np.arange(len(number)) + np.repeat(np.arange(len(texts)), lengths)
    symbols[inside] = number
    symbols[-1] = n_symbols - 1
    index = FMIndex(symbols, n_symbols)
    text = np.repeat(np.arange(len(texts)), owned)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(owned) - owned, owned)
    reached, lo, _ = index.search(symbols, begin[text] + nth + width - 1, width)
    again = np.zeros(len(text), bool)
    shared = np.flatnonzero(reached == width)
    first = np.full(len(symbols) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, lo[shared], order[shared])
    again[shared] = order[shared] > first[lo[shared]]
    return again


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``n_removed``, ``spans`` (in words) and ``kept_sha256`` of every row.

    Removes each word under a window of 20 words that also starts earlier; see
    ``repeats.remove_repeats`` for ties, nulls and repeated rows. Other columns are not looked
    at; an empty table gives no rows.
    """
    found = remove_repeats(docs, repeated_windows, WordUnits, WIDTH, GRAM, key, text, 1 << 17)
    return found.withColumnRenamed("n", "n_words")
