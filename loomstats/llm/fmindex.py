"""FM-index over runs of symbols: suffix ranks, wavelet matrix of the transformed text, sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


class Bits:
    """Bits with counts of ones before any position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros(n // 64 + 1, np.uint64)
        raw = np.packbits(bits, bitorder="little")
        packed.view(np.uint8)[: len(raw)] = raw
        self.words = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """Rank and access over a sequence of small whole numbers."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (sequence >> shift) & 1 == 1
            zeros = int(len(sequence) - np.count_nonzero(bit))
            self.levels.append((shift, Bits(bit), zeros))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often `symbol` is before position i."""
        low = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            ones_low, ones = bits.ones(low), bits.ones(i)
            low = np.where(one, zeros + ones_low, low - ones_low)
            i = np.where(one, zeros + ones, i - ones)
        return i - low

    def get(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = bits.get(i) == 1
            ones = bits.ones(i)
            symbol |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return symbol


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Rank of each suffix. Zeros end runs and differ from each other, by position; the last symbol is zero.

    Prefix doubling: only suffixes that still share their rank are sorted again.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    counts = np.bincount(text)
    first = np.concatenate([[0], np.cumsum(counts)])
    rank = first[text]
    rank[ends] = np.arange(len(ends))
    open_ = np.flatnonzero((text != 0) & (counts[text] > 1))
    step = 1
    while len(open_):
        key = rank[open_] * np.int64(n + 1) + rank[np.minimum(open_ + step, n - 1)]
        order = np.argsort(key, kind="stable")
        at, key = open_[order], key[order]
        old = rank[at]
        place = np.arange(len(at))
        new_group = np.concatenate([[True], key[1:] != key[:-1]])
        old_group = np.concatenate([[True], old[1:] != old[:-1]])
        start_new = np.maximum.accumulate(np.where(new_group, place, 0))
        start_old = np.maximum.accumulate(np.where(old_group, place, 0))
        rank[at] = old + start_new - start_old
        alone = new_group & np.concatenate([new_group[1:], [True]])
        open_ = at[~alone]
        step *= 2
    return rank


class FMIndex:
    """Counts and positions of patterns in runs of symbols 1..symbols-1; `text` has a 0 after each run."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        rank = suffix_ranks(text)
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        self.size = n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        before = text[suffix - 1]  # of the first suffix: the last zero
        self.transformed = Wavelet(before, symbols)
        sampled = (suffix % SAMPLE == 0) | (before == 0)
        self.marks, self.samples = Bits(sampled), suffix[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of each pattern; patterns are rows, filled from the left."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((back <= lengths) & (low < high))
            symbol = patterns[live, lengths[live] - back]
            low[live] = self.first[symbol] + self.transformed.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.transformed.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to a sampled row, counting steps."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(self.marks.get(rows) == 0)
        while len(todo):
            at = rows[todo]
            symbol = self.transformed.get(at)
            rows[todo] = self.first[symbol] + self.transformed.rank(symbol, at)
            steps[todo] += 1
            todo = todo[self.marks.get(rows[todo]) == 0]
        return self.samples[self.marks.ones(rows)] + steps
