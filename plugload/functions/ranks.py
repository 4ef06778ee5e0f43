"""Order statistics used inside Spark tasks: of many index ranges at once (numpy), and of a changing multiset."""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort

import numpy as np


def select_in_ranges(codes: np.ndarray, weights: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For every range [lo, hi) the code at 0-based weighted rank k.

    Descends from the highest code bit: the rows are split into zeros and ones keeping their order, cumulative
    counts move each range into the right half. One pass over all rows and ranges per bit, no Python loop per row.
    """
    lo, hi, k = lo.copy(), hi.copy(), k.copy()
    result = np.zeros(len(k), dtype=np.int64)
    bits = int(codes.max()).bit_length() if len(codes) else 0
    for bit in reversed(range(bits)):
        one = (codes >> bit) & 1 == 1
        zeros_before = np.concatenate(([0], np.cumsum(~one)))
        weight_before = np.concatenate(([0], np.cumsum(np.where(one, 0, weights))))
        zero_weight = weight_before[hi] - weight_before[lo]
        right = k >= zero_weight
        k -= np.where(right, zero_weight, 0)
        first_one = zeros_before[-1]
        lo = np.where(right, first_one + lo - zeros_before[lo], zeros_before[lo])
        hi = np.where(right, first_one + hi - zeros_before[hi], zeros_before[hi])
        result |= right.astype(np.int64) << bit
        codes = np.concatenate((codes[~one], codes[one]))
        weights = np.concatenate((weights[~one], weights[one]))
    return result


class RankedValues:
    """A multiset of numbers by rank: insert, remove and look up the k-th smallest.

    A tree of two levels: sorted blocks of at most 2 * BLOCK values with their sizes. An operation moves at most one
    block and adds up the block sizes, so it costs O(BLOCK + n / BLOCK) cheap steps. ``dump`` and ``load`` copy memory.
    """

    BLOCK = 512

    def __init__(self) -> None:
        self.blocks: list[array] = []
        self.highest: list[float] = []

    def __len__(self) -> int:
        return sum(map(len, self.blocks))

    def insert(self, value: float) -> None:
        if not self.blocks:
            self.blocks.append(array("d", [value]))
            self.highest.append(value)
            return
        k = min(bisect_left(self.highest, value), len(self.blocks) - 1)
        block = self.blocks[k]
        insort(block, value)
        self.highest[k] = block[-1]
        if len(block) > 2 * self.BLOCK:
            self.blocks[k : k + 1] = [block[: self.BLOCK], block[self.BLOCK :]]
            self.highest[k : k + 1] = [block[self.BLOCK - 1], block[-1]]

    def remove(self, value: float) -> None:
        k = bisect_left(self.highest, value)
        at = bisect_left(self.blocks[k], value) if k < len(self.blocks) else 0
        if k == len(self.blocks) or self.blocks[k][at] != value:
            raise KeyError(value)
        del self.blocks[k][at]
        if self.blocks[k]:
            self.highest[k] = self.blocks[k][-1]
        else:
            del self.blocks[k], self.highest[k]

    def at(self, rank: int) -> float:
        """The value of a rank, counted from 0."""
        for block in self.blocks:
            if rank < len(block):
                return block[rank]
            rank -= len(block)
        raise IndexError(rank)

    def median(self) -> float | None:
        n = len(self)
        return (self.at((n - 1) // 2) + self.at(n // 2)) / 2 if n else None

    def dump(self) -> bytes:
        return b"".join(block.tobytes() for block in self.blocks)

    @classmethod
    def load(cls, data: bytes) -> RankedValues:
        """From ``dump`` or any sorted doubles."""
        ranked, values = cls(), array("d", data)
        ranked.blocks = [values[i : i + cls.BLOCK] for i in range(0, len(values), cls.BLOCK)]
        ranked.highest = [block[-1] for block in ranked.blocks]
        return ranked
