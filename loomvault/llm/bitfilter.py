"""A one-hash bit filter of bounded size over 64-bit hashes: what it lets through holds every wanted row and few others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def bits_for(n: int) -> int:
    """16 bits a row, within bounds: past 8 million rows the filter lets more through and stays at 16 MB."""
    size = LEAST_BITS
    while size < MOST_BITS and size < 16 * n:
        size *= 2
    return size


def build(hashes: DataFrame, bits: int) -> bytes:
    """The filter over the long column h. Aggregated to at most bits/32 rows before the driver sees any."""
    at = hashes.filter("h is not null").select(F.pmod(F.col("h"), F.lit(bits)).alias("at"))
    words = at.select(F.expr("cast(at div 32 as int) as w"), F.expr("shiftleft(1L, cast(at % 32 as int)) as v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint32)
    return out.tobytes()


def passes(table: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which int64 hashes may be in the filter."""
    words = np.frombuffer(table, np.uint32)
    at = hashes & np.int64(len(words) * 32 - 1)
    return ((words[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)
