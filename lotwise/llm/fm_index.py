"""An FM-index over integer sequences: counting and locating many phrases at once."""

from __future__ import annotations

import numpy as np

# Every so many positions of a run keep their place in the text.
SAMPLED = 16


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = np.append(0, self.before)[:-1]
        self.ones = int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Ranks of symbols in a sequence, one bit vector per bit of a symbol (all nodes of a level side by side)."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        now = symbols
        for bit in reversed(range(max(1, (size - 1).bit_length()))):
            ones = (now >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), len(now) - int(ones.sum())))
            now = np.concatenate([now[~ones], now[ones]])
        self.begin = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbol, at) - self.begin[symbol]

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for bit, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.begin[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. 0 ends a run; every 0 counts as a symbol of its own."""
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + int(ends.sum()))
    length = 1
    while True:
        after = np.zeros_like(rank)
        after[:-length or None] = rank[length:]
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key)
        new = np.append(0, np.cumsum(np.diff(key[order]) > 0))
        rank = np.empty_like(rank)
        rank[order] = new
        if new[-1] == len(symbols) - 1:
            return order
        length *= 2


class FmIndex:
    """Over symbols from 1 to ``size`` - 1 in runs that each end with 0, the last one included."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        symbols = symbols.astype(np.int64)
        order = suffix_array(symbols)
        self.size, self.length = size, len(symbols)
        counts = np.bincount(symbols, minlength=size)
        self.first = np.cumsum(counts) - counts
        self.tree = WaveletTree(symbols[order - 1], size)
        begins = np.append(True, symbols[:-1] == 0)
        kept = begins[order] | (order % SAMPLED == 0)
        self.kept, self.place = Bits(kept), order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the range [low, high) of suffixes that begin with each phrase.

        ``phrases``: one per row, left-aligned, of ``lengths`` symbols from 1 on.
        """
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.length, np.int64)
        open_ = np.flatnonzero(lengths > 0)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            open_ = open_[(lengths[open_] >= back) & (low[open_] < high[open_])]
            if not len(open_):
                break
            symbol = phrases[open_, lengths[open_] - back].astype(np.int64)
            low[open_] = self.first[symbol] + self.tree.rank(symbol, low[open_])
            high[open_] = self.first[symbol] + self.tree.rank(symbol, high[open_])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffixes, walking left to the nearest sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.kept.get(at))
        while len(walking):
            symbol, rank = self.tree.get(at[walking])
            at[walking] = self.first[symbol] + rank
            steps[walking] += 1
            walking = walking[~self.kept.get(at[walking])]
        return self.place[self.kept.rank(at)] + steps
