"""A bounded bitmap of 64-bit keys that Python scans use to skip rows which no join would keep."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bitmap has at most so many bits (64 MiB).
MAX_BITS = 1 << 29
_PAGE_BITS = 32768  # of Spark's bitmap functions


class KeyFilter:
    """May hold false positives, never false negatives; a join must follow."""

    def __init__(self, bits: Broadcast, size: int):
        self.bits, self.size = bits, size

    def hits(self, keys: np.ndarray) -> np.ndarray:
        at = (keys & np.uint64(self.size - 1)).astype(np.int64)
        return (self.bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def key_filter(keys: DataFrame, column: str, n: int, max_bits: int = MAX_BITS) -> KeyFilter:
    """The filter of n keys. The more of the largest bitmap they fill, the more passes; the plan stays the same."""
    size = min(max_bits, max(_PAGE_BITS, 1 << (32 * n).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(size - 1).cast("long")) + 1
    pages = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros(max(size, _PAGE_BITS) // 8, np.uint8)
    for row in pages.toLocalIterator():  # size / 32768 rows at most
        bits[(row.page - 1) * _PAGE_BITS // 8 : row.page * _PAGE_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return KeyFilter(keys.sparkSession.sparkContext.broadcast(bits), size)
