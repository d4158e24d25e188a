"""A Bloom filter of 64-bit hashes, made by Spark and broadcast to tasks.

The filter only thins out what is shuffled afterwards; what it lets through is
always checked exactly.  So its size is bounded, whatever the input: beyond the
bound it lets more through, and the results stay the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each hash, and bits at most (16 MB).
BITS_PER_HASH = 16
MOST_BITS = 1 << 27


@dataclass
class BloomFilter:
    """``bits`` has a power of two of bits, as 64-bit words."""

    bits: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the unsigned ``hashes`` may have been entered."""
        mask = np.uint64(64 * len(self.bits) - 1)
        found = np.ones(len(hashes), bool)
        for place in (hashes & mask, (hashes >> np.uint64(32)) & mask):
            found &= (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def bloom_filter(hashes: DataFrame, name: str, most_bits: int | None = None) -> BloomFilter:
    """The filter of a column of longs without nulls.  The words are put
    together by an aggregation; the driver sees these alone."""
    n = max(1, hashes.count())
    bits = min(most_bits or MOST_BITS, 1 << max(10, (n * BITS_PER_HASH - 1).bit_length()))
    places = F.explode(F.array(F.col(name).bitwiseAND(bits - 1), F.shiftrightunsigned(name, 32).bitwiseAND(bits - 1)))
    words = hashes.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("m")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[np.asarray(words["w"], dtype=np.int64)] = np.asarray(words["m"], dtype=np.int64).view(np.uint64)
    return BloomFilter(out)


def may_hold(spark: SparkSession, held: BloomFilter, hashes: Column) -> Column:
    """Whether a long may have been entered; only the longs go to Python."""
    shared = spark.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def probe(h: pa.Array) -> pa.Array:
        return pa.array(shared.value.holds(np.asarray(h).astype(np.int64).view(np.uint64)))

    return probe(hashes)
