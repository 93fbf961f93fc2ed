"""A Bloom filter of bounded size over the digests that occur more than once.

What it rejects is surely alone and need not be shuffled to be compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter, at most.
FILTER_BITS = 1 << 27


def _places(digest: Column, bits: int) -> list[Column]:
    """Two positions in the filter."""
    return [F.pmod(F.xxhash64(F.lit(k), digest), F.lit(bits)) for k in (1, 2)]


def may_repeat(index: DataFrame, most: int = FILTER_BITS) -> Callable[[Column], Column]:
    """From (digest, n): a test of digests that is true for each with n > 1, and for few others."""
    twice = index.where("n > 1").select("digest")
    bits = min(most, max(1024, 1 << (16 * twice.count()).bit_length()))
    places = twice.select(F.explode(F.array(*_places(F.col("digest"), bits))).alias("b"))
    words = places.groupBy(F.expr("b div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("x"))
    table = np.zeros(bits // 32, dtype=np.uint32)
    found = words.toArrow()  # columns of numbers, at most as many as the largest filter has words
    table[found["w"].to_numpy()] = found["x"].to_numpy().astype(np.uint32)
    sent = index.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def found(first: pd.Series, second: pd.Series) -> pd.Series:
        hit = [sent.value[at >> 5] >> (at & 31).astype(np.uint32) & 1 for at in (first.to_numpy(), second.to_numpy())]
        return pd.Series((hit[0] & hit[1]).astype(bool))

    return lambda digest: found(*_places(digest, bits))
