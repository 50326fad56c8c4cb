"""Bloom filters of a bounded size, so that broadcasting one has a bound whatever the corpus.

They only ever thin out rows ahead of an exact join or check: a full filter lets everything through, which costs time
and changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays

#: Bits of a filter's size: 16 for each key that is expected, between 2^20 (128 kB) and 2^27 (16 MB).
LEAST_BITS, MOST_BITS = 20, 27


class KeyFilter:
    """A Bloom filter over 64-bit hashes: may let others through, never keeps a member out."""

    def __init__(self, keys: DataFrame, column: str, expected: int | None = None):
        expected = keys.count() if expected is None else expected
        self.bits = min(max((16 * expected).bit_length(), LEAST_BITS), MOST_BITS)
        size = (1 << self.bits) - 1
        bits = keys.select(F.explode(F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(size) for s in (0, 32)])).alias("bit"))
        words = bits.groupBy(F.shiftright("bit", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 31))")).alias("word"))
        table = words.toArrow()  # 2^(bits - 5) rows at most
        self.words = np.zeros(1 << (self.bits - 5), np.uint32)
        self.words[table["at"].to_numpy()] = table["word"].to_numpy()

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys may be members."""
        out = np.ones(len(keys), bool)
        for shift in (0, 32):
            bit = (keys.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            out &= (self.words[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & 1 == 1
        return out


def likely(rows: DataFrame, key: Column, keys: DataFrame, column: str, expected: int | None = None) -> DataFrame:
    """The rows whose key (a 64-bit hash) may be among the hashes in `keys`.`column`."""
    shared = rows.sparkSession.sparkContext.broadcast(KeyFilter(keys, column, expected))

    def run(batches):
        for batch in batches:
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(shared.value.has(batch.column(batch.num_columns - 1).to_numpy())))

    return rows.withColumn("_key", key).mapInArrow(arrays.tidied(run), rows.schema)
