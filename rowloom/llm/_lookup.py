"""Vectorised look-ups of 64-bit keys: a hash index, and Bloom filters of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIX = np.uint64(0x9E3779B97F4A7C15)


class HashIndex:
    """Places of distinct keys; open addressing, at most a quarter full.

    Only the keys are pickled; the slots are filled where keys are first looked up.
    """

    def __reduce__(self):
        return HashIndex, (self.keys,)

    def __init__(self, keys: np.ndarray):
        self.keys, self.at = np.ascontiguousarray(keys, np.uint64), None

    def _fill(self) -> None:
        keys = self.keys
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.at = np.full(1 << bits, -1, np.int32)
        self.key = np.zeros(1 << bits, np.uint64)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several, one stays
            self.key[slot[free]] = keys[left[free]]
            missed = self.at[slot] != left
            self.key[slot[~missed]] = keys[left[~missed]]
            left, slot = left[missed], (slot[missed] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if there is none."""
        if self.at is None:
            self._fill()
        slot = self._slot(keys)
        out = self.at[slot]
        ask = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        while len(ask):
            slot[ask] = (slot[ask] + 1) & self.last
            out[ask] = self.at[slot[ask]]
            ask = ask[(out[ask] >= 0) & (self.key[slot[ask]] != keys[ask])]
        return out


_U = np.uint64
_PROBES = 4
#: Limit of a Bloom filter's bits; beyond, it lets more through.
BLOOM_BITS = 1 << 27


def bloom(keys: DataFrame, limit: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of a column of keys, at most ``limit`` bits, built by the executors as 64-bit words."""
    keys = keys.toDF("key")
    bits = 1 << 16
    n = keys.count()
    while bits < min(limit, 16 * n):
        bits *= 2
    places = F.array(*[F.col("key").bitwiseXOR(F.shiftrightunsigned("key", 7 + 13 * i)).bitwiseAND(F.lit(bits - 1)) for i in range(_PROBES)])
    at = keys.select(F.explode(places).alias("p"))
    parts = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(p & 63)))").alias("v"))
    got = parts.toArrow()
    words = np.zeros(bits // 64, _U)
    words[got.column("w").to_numpy()] = got.column("v").to_numpy().view(_U)
    return words


def inside(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a Bloom filter lets through."""
    last = _U(len(filter_) * 64 - 1)
    out = np.ones(len(keys), bool)
    for i in range(_PROBES):
        p = (keys ^ (keys >> _U(7 + 13 * i))) & last
        out &= (filter_[(p >> _U(6)).astype(np.int64)] >> (p & _U(63))) & _U(1) == 1
    return out
