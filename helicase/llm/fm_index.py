"""FM-index over integer sequences: wavelet matrix ranks, backward search, located by sampled suffix positions. All queries run together in numpy."""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Bits:
    """A bit vector with constant-time rank: counts before each 64-bit word, and the word's own bits."""

    def __init__(self, bits: np.ndarray) -> None:
        words = -(-len(bits) // BLOCK) + 1
        padded = np.zeros(words * BLOCK, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at // BLOCK, (at % BLOCK).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at // BLOCK] >> (at % BLOCK).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """Wavelet matrix: a bit vector for each bit of the symbols, most significant first; zeros go left, ones right."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.levels, self.depth = [], depth
        for d in reversed(range(depth)):
            bits = (symbols >> d) & 1
            self.levels.append(Bits(bits.astype(np.uint8)))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.n = len(symbols)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position at[i]."""
        start = np.zeros_like(at)
        for level, d in zip(self.levels, reversed(range(self.depth)), strict=True):
            one = ((symbol >> d) & 1).astype(bool)
            s, e = level.rank(start), level.rank(at)
            zeros = self.n - level.ones
            start, at = np.where(one, zeros + s, start - s), np.where(one, zeros + e, at - e)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for level in self.levels:
            bit = level.get(at).astype(np.int64)
            one, zeros = bit.astype(bool), self.n - level.ones
            s, e = level.rank(start), level.rank(at)
            start, at = np.where(one, zeros + s, start - s), np.where(one, zeros + e, at - e)
            symbol = symbol * 2 + bit
        return symbol, at - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling: suffixes ranked by 1, 2, 4, ... symbols until all ranks differ."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[: n - step] = rank[step:]
        key = rank * (n + 1) + nxt + 1
        order = np.argsort(key)
        new = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]).astype(np.int64))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Index of a text of symbols 1..size; symbol 0 is the end mark, added here."""

    def __init__(self, text: np.ndarray, size: int, sample: int = 8) -> None:
        text = np.append(text.astype(np.int64), 0)
        sa = suffix_array(text)
        last = text[sa - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size + 1))])
        self.wavelet = Wavelet(last, max(1, int(size).bit_length()))
        self.n = len(text)
        sampled = sa % sample == 0
        self.sampled, self.positions = Bits(sampled.astype(np.uint8)), sa[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of patterns, right-aligned rows of symbols; empty where a pattern doesn't occur."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for j in range(1, width + 1):
            live = np.flatnonzero((lengths >= j) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, width - j]
            low[live] = self.starts[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.starts[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back through the text to the next sampled one."""
        out, steps, at = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        todo = np.arange(len(rows))
        while len(todo):
            here = self.sampled.get(at[todo]).astype(bool)
            done = todo[here]
            out[done] = self.positions[self.sampled.rank(at[done])] + steps[done]
            todo = todo[~here]
            symbol, rank = self.wavelet.access(at[todo])
            at[todo] = self.starts[symbol] + rank
            steps[todo] += 1
        return out
