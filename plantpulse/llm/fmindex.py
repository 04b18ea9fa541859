"""FM-index of a sequence of small numbers in numpy: wavelet-matrix ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks of symbols: one bit vector per bit of a symbol, highest first, zeros moved to the front."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1 == 1
            self.levels.append((shift, Bits(bit), int(len(symbols) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start = np.zeros_like(place)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            before, at = bits.rank(start), bits.rank(place)
            start, place = np.where(one, zeros + before, start - before), np.where(one, zeros + at, place - at)
        return place - start

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol, start = np.zeros_like(place), np.zeros_like(place)
        for _, bits, zeros in self.levels:
            one = bits.get(place)
            before, at = bits.rank(start), bits.rank(place)
            symbol = symbol << 1 | one
            start, place = np.where(one, zeros + before, start - before), np.where(one, zeros + at, place - at)
        return symbol, place - start


def suffix_array(sequence: np.ndarray, sigma: int) -> np.ndarray:
    """Suffixes in order, by doubling. 0 ends a suffix; suffixes equal up to there keep the order of their places.

    The last number must be 0.
    """
    n, width = len(sequence), max(1, (sigma - 1).bit_length())
    packed = max(1, 62 // width)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(packed):
        symbol = np.zeros(n, np.int64)
        symbol[: max(0, n - k)] = sequence[k:]
        symbol[~alive] = 0
        key = key << width | symbol
        alive &= symbol != 0
    order = np.argsort(key, kind="stable")
    tied = key[order]
    first = np.concatenate([[True], tied[1:] != tied[:-1]])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    rank = np.empty(n, np.int64)
    rank[order] = np.where(alive[order], head, np.arange(n))
    slots = np.flatnonzero(alive[order] & ~(first & np.append(first[1:], True)))
    step = packed
    while len(slots):
        places = order[slots]
        group, then = rank[places], rank[places + step]
        by = np.lexsort((then, group))
        places, group, then = places[by], group[by], then[by]
        order[slots] = places
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        rank[places] = slots[np.flatnonzero(first)[np.cumsum(first) - 1]]
        slots = slots[~(first & np.append(first[1:], True))]
        step *= 2
    return order


class FMIndex:
    """Backward search in runs of symbols 1 .. sigma - 1, each run ended by 0."""

    def __init__(self, sequence: np.ndarray, sigma: int, sample: int = 8):
        order = suffix_array(sequence, sigma)
        counts = np.bincount(sequence, minlength=sigma)
        self.smaller = np.cumsum(counts) - counts
        self.size = len(sequence)
        self.ranks = WaveletMatrix(np.where(order > 0, sequence[order - 1], 0).astype(np.int64), sigma)
        starts = np.concatenate([[0], np.flatnonzero(sequence == 0)[:-1] + 1])
        into = np.arange(len(sequence)) - np.repeat(starts, np.diff(np.append(starts, len(sequence))))
        kept = into[order] % sample == 0  # a walk to the left ends inside its run
        self.sampled, self.places = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the patterns that occur (rows, filled up with zeros on the left): their row and its range of suffixes."""
        row = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        for step in range(1, patterns.shape[1] + 1):
            going = lengths[row] >= step
            symbol = patterns[row, -step].astype(np.int64)
            ends = self.ranks.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + self.smaller[np.concatenate([symbol, symbol])]
            low, high = np.where(going, ends[: len(row)], low), np.where(going, ends[len(row) :], high)
            found = high > low
            row, low, high = row[found], low[found], high[found]
        return row, low, high

    def locate(self, suffix: np.ndarray) -> np.ndarray:
        """The places of suffixes, from the next sampled one to the left."""
        out, steps = np.empty(len(suffix), np.int64), 0
        waiting = np.arange(len(suffix))
        while len(waiting):
            done = self.sampled.get(suffix)
            out[waiting[done]] = self.places[self.sampled.rank(suffix[done])] + steps
            waiting, suffix = waiting[~done], suffix[~done]
            symbol, before = self.ranks.access(suffix)
            suffix, steps = self.smaller[symbol] + before, steps + 1
        return out
