"""A bitmap of hashes: which rows of a large table may be wanted, told without a shuffle.

It has 8 to 16 bits a wanted row, but never fewer than 2 ** LEAST nor more than 2 ** MOST, so the broadcast has at most
16 MB. A set bit only says "maybe"; the exact join that follows decides. Beyond 2 ** MOST wanted rows most rows are let
through, and the exact join does the work. The bits are gathered in tasks, 32,768 to a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 20, 27


class Bitmap:
    """The bits that the keys of the wanted rows set. ``wanted`` is read twice: a materialized table, or rows picked from one."""

    def __init__(self, wanted: DataFrame, *keys: str) -> None:
        self.keys, self.size = keys, 1 << min(MOST, max(LEAST, (8 * wanted.count() - 1).bit_length()))
        found = wanted.select((self.bit() + 1).alias("b"))
        parts = found.groupBy(F.bitmap_bucket_number("b").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
        bits = np.zeros(self.size // 8, np.uint8)
        for r in parts.collect():
            bits[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
        self.bits: Broadcast = wanted.sparkSession.sparkContext.broadcast(bits)

    def bit(self) -> Column:
        """The place of a row's keys."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.size))


def look_up(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def maybe_in(wanted: DataFrame, *keys: str) -> Column:
    """A condition over the same key columns of another table: false only where no wanted row has the key."""
    own = Bitmap(wanted, *keys)
    bits = own.bits

    @F.pandas_udf("boolean")
    def look(b: pd.Series) -> pd.Series:
        return pd.Series(look_up(bits.value, b.to_numpy(np.int64)))

    return look(own.bit())
