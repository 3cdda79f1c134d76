"""Bloom filters of 64-bit keys, of a bounded size, for pruning on the map side.

What a filter lets through too much has to be dropped later, by an exact join or
sum; what it holds it never keeps out. Spark puts it together in parts of 4 KB.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.words import U64, mix

#: 2^FILTER_POWER bits at most (32 MB); beyond 16 million keys a filter prunes less.
FILTER_POWER = 28
#: A key's places in a filter are its bits from here on.
KEY_SHIFTS = (0, 18, 36)


def bucket_of(keys: np.ndarray, power: int) -> np.ndarray:
    """The first `power` bits."""
    return (keys >> U64(64 - power)).astype(np.int64) if power else np.zeros(len(keys), np.int64)


def spread(bucket: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """One key from a bucket and the last 32 bits within it."""
    return mix(bucket.astype(U64) << U64(32) | rest.astype(U64))


class KeySet:
    """A filter over keys that Spark has seen; `buckets` says how phrase keys were cut to them (key_filter.spread)."""

    def __init__(self, bits: np.ndarray, power: int, buckets: int = 0):
        self.bits, self.mask, self.buckets = bits, U64((1 << power) - 1), buckets

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in KEY_SHIFTS:
            at = (keys >> U64(shift)) & self.mask
            out &= (self.bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
        return out

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether the filter holds the bucket and last 32 bits of each phrase key."""
        return self.holds(spread(bucket_of(keys, self.buckets), keys & U64(0xFFFFFFFF)))


def key_set(keys: DataFrame, buckets: int = 0, most: int = FILTER_POWER) -> KeySet:
    """The filter of all rows of `key`, put together by Spark; 2^most bits reach the driver at most."""
    n = keys.count()
    power = min(most, max(16, int(16 * n).bit_length()))
    unsigned = lambda s: F.shiftrightunsigned("key", s).bitwiseAND(F.lit((1 << power) - 1))
    place = keys.select(F.explode(F.array(*[unsigned(s) for s in KEY_SHIFTS])).alias("place")).select((F.col("place") + 1).alias("place"))
    parts = place.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(1 << power >> 3, np.uint8)
    for part in parts.collect():
        found = np.frombuffer(bytes(part["bits"]), np.uint8)
        at = (part["part"] - 1) * len(found)
        bits[at : at + len(found)] = found[: len(bits) - at]
    return KeySet(bits, power, buckets)
