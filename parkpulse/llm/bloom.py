"""A Bloom filter built by Spark and sent to every task; its size is bounded whatever the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 4 MB. Beyond it the filter only lets more through; what follows is exact either way.
MAX_BITS = 1 << 25


class Bloom:
    """Two probes per 64-bit key; the keys must be well mixed."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for shift in (0, 32):
            at = (keys >> np.uint64(shift)) & self.mask
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def bloom_of(keys: DataFrame, column: str) -> Bloom:
    """Filter of the non-null BIGINT keys. Its words are combined by Spark; the driver gets each once."""
    bits = 1 << 12
    n = keys.count()
    while bits < min(MAX_BITS, 32 * n):
        bits *= 2
    key, low = F.col(column), F.lit(bits - 1).cast("bigint")
    probes = F.explode(F.array(key.bitwiseAND(low), F.shiftrightunsigned(key, 32).bitwiseAND(low)))
    rows = (
        keys.where(key.isNotNull())
        .select(probes.alias("at"))
        .select(
            F.shiftright("at", 6).alias("word"),
            F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Bloom(words)
