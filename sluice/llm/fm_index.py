"""An FM-index over word numbers: the Burrows-Wheeler transform of a text in a wavelet matrix of packed bits.

Suffixes are ordered by their first ``DEPTH`` words only. Backward search of a pattern of m words needs the order of the
first m words alone, so every pattern of up to DEPTH words is searched exactly.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16


class Bits:
    """Packed bits with counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        full = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        full[:n] = bits
        self.words = np.packbits(full, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class Wavelet:
    """Rank of any symbol in a sequence, a level of packed bits for each bit of the symbols."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        now = sequence
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (now >> shift & 1).astype(np.uint8)
            zeros = int(len(bit) - bit.sum())
            self.levels.append((shift, Bits(bit), zeros))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.origin = self.walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self.walk(symbol, at) - self.origin[symbol]


class FmIndex:
    """text: word numbers from 1, with 0 between pieces and at the end; owner: the document of each word. Kept are packed
    bits (the wavelet matrix and where groups of equal first words begin) and an owner for each group."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, span: int) -> None:
        if span > DEPTH:
            raise ValueError("the suffix order is not that deep")
        n, symbols = len(text), int(text.max(initial=0)) + 1
        order_of, step = text.astype(np.int64), 1
        eight = order_of
        while step < DEPTH:
            after = np.zeros(n, np.int64)
            after[: n - step] = order_of[step:] + 1
            order_of = np.unique(order_of * (n + symbols + 2) + after, return_inverse=True)[1].astype(np.int64)
            step *= 2
            if step == 8:
                eight = order_of
        rows = np.argsort(order_of, kind="stable")
        self.bwt = Wavelet(text[rows - 1].astype(np.int64), symbols)
        self.start = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=symbols), out=self.start[1:])
        self.n = n
        # rows that agree on their first span words stand together: where such a group begins, and its least owner
        rest = np.full(n, -1, np.int64)
        rest[: max(0, n - (span - 8))] = eight[span - 8 :]
        a, b = eight[rows], rest[rows]
        fresh = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if n else np.zeros(0, np.int64)
        begins = np.zeros(n, np.uint8)
        begins[fresh] = 1
        self.groups = Bits(begins)
        self.group_owner = np.minimum.reduceat(owner[rows], fresh) if n else owner

    def least(self, row: np.ndarray) -> np.ndarray:
        """The least owner among the rows that agree with each row on their first span words."""
        return self.group_owner[self.groups.ones(row + 1) - 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of symbol + pattern from those of pattern."""
        return self.start[symbol] + self.bwt.rank(symbol, low), self.start[symbol] + self.bwt.rank(symbol, high)


def matching(index: FmIndex, stream: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics of stream (words of the index, 0 between pieces) at the given ends: how many words up to and
    including each end are found more than once in the index, counted to span at most, and the first row of the range
    of those that reach span."""
    length, row = np.zeros(len(ends), np.int64), np.full(len(ends), -1, np.int64)
    live = np.arange(len(ends))
    low, high = np.zeros(len(ends), np.int64), np.full(len(ends), index.n, np.int64)
    for k in range(span):
        at = ends[live] - k
        low, high = index.extend(stream[at], low, high)
        on = high - low > 1
        live, low, high = live[on], low[on], high[on]
        length[live] = k + 1
        if not len(live):
            break
    row[live] = low
    return length, row


def intervals(length: np.ndarray, least: np.ndarray, piece: np.ndarray, place: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of words above the threshold: runs of consecutive windows of one piece whose matching length
    reaches span and that have one least owner. length, least, piece and place (first word in the piece) of each window,
    in order; returns piece, first word, end (exclusive) and least owner of each interval."""
    on = np.flatnonzero(length >= span)
    new = np.ones(len(on), bool)
    new[1:] = (np.diff(on) > 1) | (np.diff(piece[on]) != 0) | (np.diff(least[on]) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(on))[: len(first)] - 1
    return piece[on[first]], place[on[first]], place[on[last]] + span, least[on[first]]
