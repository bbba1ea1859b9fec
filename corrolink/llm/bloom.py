"""Bloom filters over hashed 64-bit values, sized from their count: filled by Spark, asked in Python workers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each value, and the least and most bits of a filter. A full filter lets more through and loses nothing.
BITS_A_VALUE, LEAST_BITS, MOST_BITS = 12, 1 << 16, 1 << 30


def build(df: DataFrame, column: str) -> np.ndarray:
    """The filter of a written column of different hashes; at most MOST_BITS / 64 words come to the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_VALUE * df.count()).bit_length()))
    places = F.explode(F.array(F.col(column).bitwiseAND(bits - 1), F.shiftrightunsigned(column, 30).bitwiseAND(bits - 1)))
    marked = df.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[marked["w"].to_numpy()] = marked["m"].to_numpy()
    return out


def holds(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    last = np.uint64(len(bloom) * 64 - 1)
    held = np.ones(len(hashes), dtype=bool)
    for p in (hashes & last, (hashes >> np.uint64(30)) & last):
        held &= (bloom[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)).astype(np.int64)) & 1 == 1
    return held
