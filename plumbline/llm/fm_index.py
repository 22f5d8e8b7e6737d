"""A compressed full-text index of word sequences: Burrows-Wheeler transform in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np

ALL = np.uint64((1 << 64) - 1)
#: Texts searched at once, few enough for their numbers to stay near the processor.
BLOCK = 4096


class Bits:
    """A bit vector with rank: 64 bits to a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(np.concatenate((bits, np.zeros(-len(bits) % 64 + 64, dtype=bool))), bitorder="little")
        self.blocks = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)[:-1]))
        self.zeros = len(bits) - int(np.count_nonzero(bits))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        above = ALL << (at & 63).view(np.uint64)
        ones = self.before.take(block, mode="clip")
        ones += np.bitwise_count(self.blocks.take(block, mode="clip") & ~above)
        return ones


class Wavelet:
    """Ranks of symbols in a sequence; a level for each bit of a symbol, from the highest."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.shifts = list(reversed(range(max(1, (symbols - 1).bit_length()))))
        self.levels = []
        for shift in self.shifts:
            bits = (sequence >> shift & 1).astype(bool)
            self.levels.append(Bits(bits))
            sequence = np.concatenate((np.compress(~bits, sequence), np.compress(bits, sequence)))
        #: Where the places of each symbol begin below the last level.
        self.start = self._follow(np.arange(symbols), np.zeros((1, symbols), dtype=np.int64))[0]

    def _follow(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level in zip(self.shifts, self.levels, strict=True):
            ones = level.rank(at)
            at = at - ones  # where a zero goes; for a one, the difference is added
            ones += level.zeros
            ones -= at
            ones &= -(symbols >> shift & 1)
            at += ones
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place; a row of ``at`` has a place for each symbol."""
        return self._follow(symbols, at) - self.start[symbols]


def ordered(high: np.ndarray, low: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of numbers up to ``limit``, equal ones by place, and the number of each pair among the distinct ones."""
    bits = limit.bit_length()
    keys = high.astype(np.uint64) << np.uint64(bits) | low.astype(np.uint64)
    places = len(keys).bit_length()
    if 2 * bits + places <= 64:  # a sort of numbers that carry their place is much faster than an argsort
        held = np.sort(keys << np.uint64(places) | np.arange(len(keys), dtype=np.uint64))
        order = (held & np.uint64((1 << places) - 1)).astype(np.int64)
        held >>= np.uint64(places)
    else:
        order = np.argsort(keys, kind="stable")
        held = keys[order]
    ranks = np.empty(len(keys), dtype=np.int64)
    ranks[order] = np.concatenate(([0], np.cumsum(held[1:] != held[:-1])))
    return order, ranks


class FMIndex:
    """Texts of symbols (1 and up), of one owner number each, searched backwards.

    ``width``: the length of the windows whose owners are asked for, 2 at least. Suffixes are ordered by as many words at least.
    """

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, width: int) -> None:
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        text = np.zeros(int(sizes.sum()) + 1, dtype=np.int64)  # a 0 ends each text
        inside = np.ones(len(text), dtype=bool)
        inside[np.append(np.cumsum(sizes) - 1, len(text) - 1)] = False
        text[inside] = np.concatenate((np.zeros(0, dtype=np.int64), *texts))
        n = len(text)
        owner = np.append(np.repeat(owners, sizes), owners.max(initial=0))
        symbols = int(text.max()) + 1
        ranks, length = text, 1
        by_length = {1: ranks}
        while length < width:
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - length)] = ranks[length:] + 1
            order, ranks = ordered(ranks, after, max(n, symbols) + 1)
            length *= 2
            by_length[length] = ranks
        self.width = width
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.bwt = Wavelet(text[order - 1].astype(np.int32), symbols)
        self.n = n
        shorter = np.flatnonzero(self._new(order, by_length, width - 1))
        spans = np.diff(np.append(shorter, n))
        self.low = np.repeat(shorter, spans)
        self.high = np.repeat(shorter + spans, spans)
        classes = np.flatnonzero(self._new(order, by_length, width))
        #: For each suffix, the least owner of those that begin with the same window.
        self.least = np.repeat(np.minimum.reduceat(owner[order], classes), np.diff(np.append(classes, n)))

    @staticmethod
    def _new(order: np.ndarray, by_length: dict[int, np.ndarray], size: int) -> np.ndarray:
        """Whether each suffix differs from the one before it in its first ``size`` words."""
        half = 1 << (size.bit_length() - 1)
        near = by_length[half].take(order)
        far = by_length[half].take(np.minimum(order + size - half, len(order) - 1))
        out = np.ones(len(order), dtype=bool)
        out[1:] = (near[1:] != near[:-1]) | (far[1:] != far[:-1])
        return out

    def extend(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns with one more symbol in front."""
        low, high = self.bwt.rank(symbols, np.stack((low, high))) + self.first[symbols]
        return low, high

    def least_owners(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of texts that are in the index, the smallest owner of its occurrences; texts of like lengths together."""
        turn = np.argsort([-len(t) for t in texts], kind="stable").tolist()
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
        for start in range(0, len(turn), BLOCK):
            block = turn[start : start + BLOCK]
            for i, found in zip(block, self._least_owners([texts[i] for i in block]), strict=True):
                out[i] = found
        return out

    def _least_owners(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The same for texts by falling length.

        All texts go backwards in step. A match grows word by word to the window's length; then its last word is given up
        (the interval widens to that of one word less) before the next one is taken in front.
        """
        held = np.array([len(t) for t in texts])
        width = int(held.max(initial=0))
        padded = np.zeros((len(texts), width), dtype=np.int64)
        for row, t in enumerate(texts):
            padded[row, width - len(t) :] = t
        padded = np.ascontiguousarray(padded.T)
        low = np.zeros(len(texts), dtype=np.int64)
        high = np.full(len(texts), self.n, dtype=np.int64)
        found = np.zeros((len(texts), max(0, width - self.width + 1)), dtype=np.int64)
        for back in range(1, width + 1):
            live = int(np.searchsorted(-held, -back, side="right"))
            if back > self.width:
                low[:live], high[:live] = self.low[low[:live]], self.high[low[:live]]
            low[:live], high[:live] = self.extend(low[:live], high[:live], padded[width - back, :live])
            if back >= self.width:
                found[:live, width - back] = self.least[low[:live]]
        return [found[row, width - len(t) : width - self.width + 1] for row, t in enumerate(texts)]
