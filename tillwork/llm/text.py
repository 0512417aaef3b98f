"""Words, row keys and batches shared by the document operators.

All operators read whole texts inside Arrow batches. Texts travel as UTF-8
bytes: lower-casing A-Z and splitting on ASCII white space are byte operations,
so other letters keep every bit. A null text is an empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
# Upper-case A-Z to lower case; every byte that is in no word to a blank.
_TO_WORDS = bytes(
    b if b in _WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

_ROW_BITS = 40


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z after lower-casing A-Z, and all non-ASCII characters."""
    return text.translate(_TO_WORDS).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and the columns in ``more``; whatever else the table has is left out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("text"),
        *more,
    )


def split_number(folds: int) -> Column:
    """crc32 of the id's digits, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


class RowKeys:
    """Numbers for the rows of this task that no other task gives.

    They hold for one run of the task, so a result that carries them is written
    before it is read twice.
    """

    def __init__(self) -> None:
        context = TaskContext.get()
        self._next = (context.partitionId() if context else 0) << _ROW_BITS

    def take(self, count: int) -> np.ndarray:
        keys = np.arange(self._next, self._next + count, dtype=np.int64)
        self._next += count
        return keys


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def slices(batches: Iterable[pa.RecordBatch], column: str, budget: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``budget`` bytes in each, one row at least."""
    for batch in batches:
        sizes = np.diff(np.asarray(_offsets(batch.column(column)), dtype=np.int64))
        if not len(sizes):
            continue
        group = np.maximum(np.cumsum(sizes) - 1, 0) // budget
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for start, end in zip(starts, [*starts[1:], len(sizes)], strict=True):
            yield batch.slice(start, end - start)


def _offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], width)[column.offset:column.offset + len(column) + 1]


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # only some C libraries can
        return None


def tidy(
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` for ``mapInArrow``, giving free memory back to the system when its task ends.

    Workers stay alive for later tasks, and what an allocator keeps adds up over those that wait.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)

    return run


def lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
