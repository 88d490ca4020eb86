"""A compressed FM-index over word sequences: truncated suffix order, BWT and wavelet matrix.

Symbols are runs of ``GRAM`` words, so a window of ``GRAM * DEPTH`` words is ``DEPTH`` symbols
and one backward step goes back ``GRAM`` words; every word position starts a suffix.
Suffixes are ordered by their first ``DEPTH`` symbols and then by place, which is all that
backward search of so many symbols needs, and puts the first occurrence of a window at the
start of its interval.
"""

from __future__ import annotations

import numpy as np

GRAM = 5
DEPTH = 4
WINDOW = GRAM * DEPTH


class WaveletMatrix:
    """Rank queries on a sequence of symbols, one packed bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        n = len(symbols)
        for bit in range(self.bits - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            padded = np.zeros((n + 64) // 64 * 64, bool)
            padded[:n] = ones
            words = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(counts)[:-1]]))
            self.zeros.append(n - int(counts.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.starts = self._follow(np.arange(size), np.zeros(size, np.int64))

    def _follow(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at = ends
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[level][word] + np.bitwise_count(self.words[level][word] & below)
            at = np.where(symbols >> bit & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        return self._follow(symbols, ends) - self.starts[symbols]


def _dense(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs in their order; both are below 2 ** 31."""
    return np.unique(first << 32 | second, return_inverse=True)[1].astype(np.int64)


class FmIndex:
    """Index of texts given as word numbers, end to end, with the length of each text."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        # every text gets one place more than it has words, so that its last GRAM places, from
        # which no whole symbol starts, are the ends of its GRAM interleaved symbol sequences
        self.begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        n = int(lengths.sum()) + len(lengths)
        left = np.repeat(self.begins + lengths, lengths + 1) - np.arange(n)  # words from here to the end
        ids = np.zeros(n + WINDOW, np.int64)
        ids[:n][left > 0] = words + 1
        two = _dense(ids[:-1], ids[1:])
        four = _dense(two[:-2], two[2:])
        five = _dense(four[: n + 1], ids[4 : n + 5])[:n]
        whole = left >= GRAM
        symbols = np.zeros(n, np.int64)
        kinds, symbols[whole] = np.unique(five[whole], return_inverse=True)
        symbols[whole] += 1
        self.symbols, self.size = symbols, len(kinds) + 1

        def ahead(x: np.ndarray, step: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            inside = np.flatnonzero(left >= step)
            out[inside] = x[inside + step]
            return out

        pairs = _dense(symbols, ahead(symbols, GRAM)) + 1
        quads = _dense(pairs, ahead(pairs, 2 * GRAM))
        self.order = np.argsort(quads, kind="stable")
        behind = np.zeros(n, np.int64)
        inside = np.flatnonzero(whole)
        behind[inside + GRAM] = symbols[inside]
        self.bwt = WaveletMatrix(behind[self.order], self.size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.size))])

    def search(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the windows of ``WINDOW`` words that start at places: how often
        each occurs, and the first place of the same words."""
        last = self.symbols[places + (DEPTH - 1) * GRAM]
        low, high = self.smaller[last], self.smaller[last + 1]
        for step in range(DEPTH - 2, -1, -1):
            symbol = self.symbols[places + step * GRAM]
            low = self.smaller[symbol] + self.bwt.rank(symbol, low)
            high = self.smaller[symbol] + self.bwt.rank(symbol, high)
        return high - low, self.order[low]
