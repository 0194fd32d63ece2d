"""Bit sets of hashes, built by the tasks and sent to all of them: filters of a bounded size that lose nothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_for(n: int, bits_each: int, most_bits: int, least_bits: int = 16) -> int:
    """A power of two with so many bits for each of n hashes, within bounds."""
    return 1 << min(most_bits, max(least_bits, (bits_each * n).bit_length()))


def collect_bits(df: DataFrame, bit: Column, size: int) -> np.ndarray:
    """The bits (places below size) of all rows as 64-bit words; at most size / 64 rows come to the driver, as Arrow."""
    words = np.zeros(size // 64, dtype=np.uint64)
    one = F.expr("shiftleft(1L, cast(bit % 64 AS int))")
    t = df.select(bit.cast("long").alias("bit")).select(F.shiftright("bit", 6).alias("w"), one.alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    words[t["w"].to_numpy()] = t["v"].to_numpy().view(np.uint64)
    return words
