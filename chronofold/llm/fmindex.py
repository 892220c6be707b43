"""An FM-index over whole numbers in numpy: backward search by wavelet-tree ranks, places by sampled suffix positions."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector that counts the ones before a place, by a running count for each 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Symbols by their bits from the highest on: a level holds one bit of each, with the zeros of the level above in front."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels = []
        for level in reversed(range(max(1, int(most).bit_length()))):
            bit = (symbols >> level & 1).astype(np.uint8)
            self.levels.append((level, Bits(bit)))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        first = np.zeros(len(at), np.int64)
        for level, bits in self.levels:
            one = (symbol >> level & 1).astype(bool)
            a, b = bits.ones(first), bits.ones(at)
            first, at = np.where(one, bits.zeros + a, first - a), np.where(one, bits.zeros + b, at - b)
        return at - first

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before that place."""
        symbol, first = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for level, bits in self.levels:
            one = bits.get(at).astype(bool)
            a, b = bits.ones(first), bits.ones(at)
            first, at = np.where(one, bits.zeros + a, first - a), np.where(one, bits.zeros + b, at - b)
            symbol |= one.astype(np.int64) << level
        return symbol, at - first


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The places of all suffixes in their order, a shorter one before those that it begins.

    Groups of suffixes that agree so far are sorted by the groups that lie as far behind them, which doubles what is
    compared in each step; only groups of two and more are looked at again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    start = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]][:n])
    size = np.diff(np.r_[start, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, size)
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    step = 1
    while len(open_):
        some = order[open_]
        behind = some + step
        key = rank[some] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[open_] = some
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        rank[some] = np.repeat(open_[start], size)
        open_ = open_[np.repeat(size > 1, size)]
        step *= 2
    return order


class FMIndex:
    """Where patterns stand in a sequence of whole numbers of 1 and more.

    The sequence ends with a 0 of its own. The last column of its sorted rotations is a wavelet tree; of the suffix
    array only each ``every``-th place of the sequence is kept, and any other is found by stepping back to one of these.
    """

    def __init__(self, symbols: np.ndarray, every: int = 16):
        text = np.append(np.asarray(symbols, np.int64), 0)
        places = suffix_array(text)
        last = text[places - 1]
        most = int(text.max())
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        self.tree = WaveletTree(last, most)
        marked = places % every == 0
        self.marked, self.sample = Bits(marked.astype(np.uint8)), places[marked]
        self.most = most

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each pattern's occurrences; ``patterns`` ends each row with its last symbol, at the right."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        active = np.flatnonzero(lengths > 0)
        for back in range(1, width + 1):
            active = active[(lengths[active] >= back) & (low[active] < high[active])]
            if not len(active):
                break
            symbol = patterns[active, width - back].astype(np.int64)
            fine = (symbol > 0) & (symbol <= self.most)
            symbol = np.where(fine, symbol, 0)
            low[active] = self.first[symbol] + self.tree.rank(symbol, low[active])
            high[active] = np.where(fine, self.first[symbol] + self.tree.rank(symbol, high[active]), low[active])
        high[lengths == 0] = 0
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the sequence that rows stand for."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, at = np.arange(len(rows)), np.asarray(rows, np.int64)
        while len(left):
            here = self.marked.get(at).astype(bool)
            out[left[here]] = self.sample[self.marked.ones(at[here])] + steps[left[here]]
            left, at = left[~here], at[~here]
            symbol, before = self.tree.get(at)
            at = self.first[symbol] + before
            steps[left] += 1
        return out
