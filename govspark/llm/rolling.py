"""Hashes of byte ranges from prefix sums, and fixed-size bitmaps of row keys."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap (2 MB). A full bitmap lets every row pass: slower, the same result.
BITS = 1 << 24


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _base(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1), int(rng.integers(1 << 40, 1 << 62)) | 5


@lru_cache(4)
def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2**64."""
    factor = _base(seed)[1]
    out = []
    for f in (factor, pow(factor, -1, 1 << 64)):
        powers = np.full(size, f % (1 << 64), np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return out[0], out[1]


class Ranges:
    """Hashes of any byte range of ``data``: equal bytes, equal hashes."""

    def __init__(self, data: np.ndarray, seed: int) -> None:
        size = 1 << max(16, len(data).bit_length())
        up, self.down = _powers(seed, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_base(seed)[0][data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)).cast("int")


def bitmap(rows: DataFrame, key: str) -> np.ndarray:
    """Bits of the keys of a frame: at most ``BITS / 64`` numbers on the driver."""
    place = rows.select(bit(F.col(key)).alias("b"))
    one = F.expr("shiftleft(1L, b % 64)")
    found = place.groupBy(F.expr("b div 64").cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def contains(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
