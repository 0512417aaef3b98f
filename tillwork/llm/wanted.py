"""Rows of a large table whose id is wanted, without shuffling the others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 26
_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    return np.stack([((ids.view(np.uint64) * m) >> np.uint64(32)).astype(np.int64) & (size - 1) for m in _MULTIPLIERS])


def marks(wanted: DataFrame, key: str, count: int) -> np.ndarray:
    """A Bloom filter of at most ``MOST_BITS`` bits (8 MB) for ``count`` long ``key`` values."""
    size = 1 << 16
    while size < MOST_BITS and size < 16 * count:
        size *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(size // 64, np.uint64)
        for batch in batches:
            for bits in _bits(batch.column(0).to_numpy(), size):
                np.bitwise_or.at(filled, bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64))
        used = np.flatnonzero(filled)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(filled[used].view(np.int64))], names=["word", "bits"])

    table = wanted.select(key).mapInArrow(mark, "word long, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(size // 64, np.uint64)
    filled[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return filled


def marked(ids: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Which of the long ``ids`` may be among those of the filter; the others are not."""
    hit = np.ones(len(ids), bool)
    for bits in _bits(ids, 64 * len(filled)):
        hit &= (filled[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) > 0
    return hit


def with_ids(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in the distinct, written table ``wanted``.

    A Bloom filter goes to all tasks and drops most other rows where they are read; a semi-join
    then decides. With so many ids that the filter fills up it drops less, and the result is the same.
    """
    filled = marks(wanted, key, wanted.count())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(batch.column(key).fill_null(0).to_numpy(), filled)))

    return rows.mapInArrow(keep, rows.schema).join(wanted, key, "left_semi")
