"""Anchors: grams of least hash that choose which strings of a text are compared."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY = 1000  # rows of one key beyond which the key goes to the rows, not the rows to the key
PIECE = 1 << 20  # starts handled at once within a document

_BASE = 0x9E3779B97F4A7C15 | 1
_WRAP = 1 << 64


class Grams:
    """Hashes of all grams of a text: sums of powers, which shift with the position, taken back to position 0."""

    def __init__(self, size: int):
        values = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)
        self.values = values * np.uint64(2) + np.uint64(1)
        self.up, self.down = self._powers(_BASE, size), self._powers(pow(_BASE, -1, _WRAP), size)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, data: np.ndarray, gram: int) -> np.ndarray:
        return self.of_values(self.values[data], gram)

    def of_values(self, values: np.ndarray, gram: int) -> np.ndarray:
        sums = self._sums(values)
        return self._mixed((sums[gram:] - sums[:-gram]) * self.down[: len(values) - gram + 1])

    def between(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = self._sums(self.values[data])
        return self._mixed((sums[end] - sums[begin]) * self.down[begin])

    def _sums(self, values: np.ndarray) -> np.ndarray:
        sums = np.empty(len(values) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return sums

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _least_in_window(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def anchors_of(data: np.ndarray, grams: Grams, length: int, gram: int):
    """(hash, place, first start, last start) of each anchor of a text, in order."""
    last = len(data) - length
    for begin in range(0, last + 1, PIECE):
        part = data[begin : min(begin + PIECE - 1, last) + length]
        hashes = grams.of(part, gram)
        bits = np.uint64((1 << 21) - 1)
        least = _least_in_window((hashes & ~bits) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        low, high = np.concatenate(([0], cut)), np.append(cut, len(least)) - 1
        at = (least[low] & bits).astype(np.int64)
        yield hashes[at].view(np.int64), at + begin, low + begin, high + begin


def those(rows: DataFrame, counted: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """rows joined with `counted`, one row per key with its number `n` of rows. Keys of over HEAVY rows are fewer than a
    HEAVY-th of the rows; they are broadcast, so that no task gets all rows of one."""
    heavy, light = F.broadcast(counted.filter(F.col(n) > HEAVY)), counted.filter(F.col(n) <= HEAVY)
    return rows.join(heavy, by).unionByName(rows.join(heavy, by, "left_anti").join(light, by))
