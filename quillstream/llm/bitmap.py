"""A bit array over 64-bit hashes: drops most rows that nobody asks for before they are shuffled.

It has eight bits a hash, up to `MOST` bits (16 MB); beyond, a fuller array lets more rows through, never fewer. An exact
join follows wherever it is used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1 << 16, 1 << 27


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The column `hash` as a bit array, built on the executors in pieces of 4 KB."""
    size = min(MOST, max(LEAST, 1 << (8 * hashes.count()).bit_length()))
    bit = F.expr(f"(hash & {size - 1}L)")
    rows = hashes.select((bit / 32768).cast("long").alias("piece"), F.pmod(bit, F.lit(32768)).alias("bit"))
    pieces = rows.groupBy("piece").agg(F.call_function("bitmap_construct_agg", F.col("bit")).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for p in pieces:
        raw = np.frombuffer(bytes(p["bits"]), np.uint8)
        out[p["piece"] * 4096 : p["piece"] * 4096 + len(raw)] = raw
    return out


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be among those of the bit array."""
    p = hashes.astype(np.int64).view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
