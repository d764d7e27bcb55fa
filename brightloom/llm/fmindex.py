"""An FM-index over the words of a shard: suffix order, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes of ``text``, whose zeros end documents. A suffix counts up to its zero;
    of equal ones the earlier comes first. Prefix doubling, and only for those not yet told apart."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the zero
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        part = np.zeros(n, np.int64)
        part[: max(0, n - k)] = text[k:]
        part[left < k] = 0
        key = (key << bits) | part
    order = np.argsort(key)
    key = key[order]
    slot = np.arange(n)
    head = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    heads = np.maximum.accumulate(np.where(head, slot, 0))
    single = head & np.concatenate((head[1:], [True]))
    rank[order] = heads
    open_slots = slot[~single]
    while True:
        done = left[order[open_slots]] < width
        if done.any():  # equal up to the end: by position
            at = open_slots[done]
            by = np.lexsort((order[at], heads[at]))
            order[at] = order[at][by]
            rank[order[at]] = at
            open_slots = open_slots[~done]
        if not len(open_slots):
            return order
        p = order[open_slots]
        pair = heads[open_slots] * np.int64(n + 1) + rank[p + width]
        by = np.argsort(pair)
        p, pair = p[by], pair[by]
        order[open_slots] = p
        head = np.concatenate(([True], pair[1:] != pair[:-1]))
        heads[open_slots] = np.maximum.accumulate(np.where(head, open_slots, 0))
        rank[p] = heads[open_slots]
        single = head & np.concatenate((head[1:], [True]))
        open_slots = open_slots[~single]
        width *= 2


class WaveletMatrix:
    """Ranks of symbols below 2**bits in a sequence: one bit vector a level, with 64-bit blocks."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.blocks, self.ahead, self.zeros = bits, [], [], []
        n = len(sequence)
        for level in range(bits):
            ones = ((sequence >> (bits - 1 - level)) & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(ones, bitorder="little")
            blocks = packed.view(np.uint64)
            counts = np.bitwise_count(blocks).astype(np.int64)
            self.blocks.append(blocks)
            self.ahead.append(np.cumsum(counts) - counts)
            self.zeros.append(n - int(counts.sum()))
            sequence = np.concatenate((sequence[~ones], sequence[ones]))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ahead[level][block] + np.bitwise_count(self.blocks[level][block] & mask)

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of the sequence falls for ``symbol`` in the last level's order: place(c, i)
        - place(c, 0) symbols c stand before i."""
        for level in range(self.bits):
            ones = self._ones(level, i)
            i = np.where((symbol >> (self.bits - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its place."""
        symbol = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            bit = ((self.blocks[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, i)
            symbol = (symbol << 1) | bit
            i = np.where(bit, self.zeros[level] + ones, i - ones)
        return symbol, i


class FMIndex:
    """Counts and locates words sequences in ``text``: symbols below 2**bits, 0 after each document."""

    def __init__(self, text: np.ndarray, bits: int, sample: int = 16):
        n = len(text)
        order = suffix_order(text, bits)
        previous = text[order - 1]  # the last zero stands before the first symbol
        self.wavelet = WaveletMatrix(previous, bits)
        symbols = np.arange(1 << bits)
        counts = np.bincount(text, minlength=1 << bits)
        self.first = np.cumsum(counts) - counts
        self.shift = self.first - self.wavelet.place(symbols, np.zeros(1 << bits, np.int64))
        kept = (order % sample == 0) | (previous == 0)
        self.kept, self.positions, self.n = kept, order[kept], n
        self.kept_ahead = np.cumsum(kept) - kept

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns are rows, right-aligned. Returns which patterns occur, and their suffix ranges."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1] if len(patterns) else 0):
            todo = lengths[which] > step
            symbol = patterns[which[todo], patterns.shape[1] - 1 - step]
            low[todo] = self.shift[symbol] + self.wavelet.place(symbol, low[todo])
            high[todo] = self.shift[symbol] + self.wavelet.place(symbol, high[todo])
            some = low < high
            which, low, high = which[some], low[some], high[some]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the nearest sampled position."""
        found = np.zeros(len(rows), np.int64)
        todo, steps, i = np.arange(len(rows)), 0, rows
        while len(todo):
            here = self.kept[i]
            found[todo[here]] = self.positions[self.kept_ahead[i[here]]] + steps
            todo, i = todo[~here], i[~here]
            if len(todo):
                symbol, place = self.wavelet.access(i)
                i = self.shift[symbol] + place
            steps += 1
        return found
