"""A Bloom filter over keys that a later join will ask for: it keeps most other rows out of the join's shuffle.

It is only a sieve before an exact join: it never drops a row that the join needs. Its size is bounded by `MOST_BITS`;
with more keys than that serves it lets more rows through, and results stay the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import ship

MOST_BITS, HASHES, BITS_A_KEY = 1 << 26, 5, 10


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    x = h.view(np.uint64)
    step = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    return (x[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


def key_filter(keys: DataFrame, key: Column) -> Callable[[Column], Column]:
    """A function from a column to whether its value may be among the keys (nulls are values like others)."""
    spark = ship(keys.sparkSession)
    bits = min(MOST_BITS, 64 * (1 + keys.count() * BITS_A_KEY // 64))

    def spread(batches):
        for batch in batches:
            p = _places(np.asarray(batch.column(0)), bits).ravel()
            word, at = np.unique((p >> np.uint64(6)).astype(np.int64), return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, at, np.uint64(1) << (p & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    found = keys.select(F.xxhash64(key).alias("h")).mapInArrow(spread, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[np.asarray(found["word"])] = np.asarray(found["mask"]).view(np.uint64)
    shared = spark.sparkContext.broadcast(words)  # MOST_BITS / 8 bytes at most

    @arrow_udf("boolean")
    def may_hold(h: pa.Array) -> pa.Array:
        p = _places(np.asarray(h), bits)
        return pa.array(((shared.value[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool).all(1))

    return lambda column: may_hold(F.xxhash64(column))
