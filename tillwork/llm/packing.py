"""Best-fit packing of whole documents into sequences of a fixed capacity.

Large-item matching: pieces above a third of the capacity share a sequence with
at most one other of their kind, found by greedy matching (the longest with the
longest that fits). Shorter pieces then go, longest first, where they leave the
smallest gap.

A sequence's content depends on lengths only, and there are at most ``capacity``
different ones. So the plan is made from the count of pieces of each length, for
any number of pieces: it states how many sequences are filled in which pattern.
The pieces themselves are numbered within their length by per-task counts and
look up their place. No task sees more than its share, a length with a third of
all pieces included.

Defined cases: a null or empty text has just the end id. Repeated rows are packed
each. Only documents longer than the capacity are cut, into pieces of the full
capacity and a last one that may be shorter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.rank_bpe import encoder
from tillwork.llm.text import documents_of, slices, task_number, tidy
from tillwork.llm.tokens import VOCABULARY, with_ends
from tillwork.sources.scratch import materialise

CAPACITY = 2048
_RANK_BITS = 44

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task long, place long"


def cut_documents(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int | None = 0,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids, in a written table.

    ``ids`` holds them as little-endian unsigned 32-bit numbers if ``keep_ids``.
    ``task`` and ``place`` number the pieces of each length within their task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", 2_000_000):
            ids, ends = with_ends(*known.encode(batch.column("text").to_pylist()), end)
            sizes = np.diff(ends, prepend=0)
            pieces = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            length = np.minimum(sizes[owner] - start, capacity)
            begin = np.r_[0, ends[:-1]][owner] + start
            data = memoryview(ids.astype("<u4").tobytes())
            parts = [data[4 * b:4 * (b + n)] for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(owner)),
                pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                pa.array([bytes(p) if keep_ids else None for p in parts], pa.binary()),
                pa.array(np.full(len(owner), task_number()), pa.int64()),
                pa.array(_places(length, seen), pa.int64()),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "place"])

    return materialise(documents_of(docs).mapInArrow(tidy(cut), PIECES), "pieces")


def _places(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Place of each piece among those of its length so far; ``seen`` is carried on."""
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    counts = np.bincount(length, minlength=len(seen))
    first = np.cumsum(counts) - counts
    places = np.empty(len(length), np.int64)
    places[order] = np.arange(len(length)) - first[ordered] + seen[ordered]
    seen += counts
    return places


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """How many sequences have which content: (sequences, [(length, pieces of it), ...])."""
    left = dict(counts)
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []

    def put(gap: int, sequences: int, content: list[tuple[int, int]]) -> None:
        if sequences:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((sequences, content))

    def take(gap: int) -> tuple[int, list[tuple[int, int]]]:
        group = open_[gap].pop()
        if not open_[gap]:
            del open_[gap]
            gaps.pop(bisect_left(gaps, gap))
        return group

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for place, length in enumerate(large):
        for mate in (m for m in large[place:] if m + length <= capacity):
            if not left[length]:
                break
            if mate == length:
                pairs, content = left[length] // 2, [(length, 2)]
                left[length] -= 2 * pairs
            else:
                pairs, content = min(left[length], left[mate]), [(length, 1), (mate, 1)]
                left[length] -= pairs
                left[mate] -= pairs
            put(capacity - length - mate, pairs, content)
        put(capacity - length, left[length], [(length, 1)])
        left[length] = 0

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        pieces = left[length]
        while pieces:
            best = bisect_left(gaps, length)
            if best == len(gaps):
                put(capacity, -(-pieces // (capacity // length)), [])
                best = bisect_left(gaps, length)
            gap = gaps[best]
            sequences, content = take(gap)
            fit = gap // length
            full = min(sequences, pieces // fit)
            if full:
                put(gap - fit * length, full, [*content, (length, fit)])
                put(gap, sequences - full, content)
                pieces -= full * fit
            else:
                put(gap - pieces * length, 1, [*content, (length, pieces)])
                put(gap, sequences - 1, content)
                pieces = 0
    return [group for gap in gaps for group in open_[gap]]


def _slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """For each run of equal places: key of the first, pieces per sequence, first sequence, offset."""
    rows, used, sequence = [], {}, 0
    for sequences, content in groups:
        offset = 0
        for length, pieces in content:
            first = used.get(length, 0)
            rows.append(((length << _RANK_BITS) + first, pieces, sequence, offset))
            used[length] = first + pieces * sequences
            offset += pieces * length
        sequence += sequences
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces of ``cut_documents``."""
    runs = pieces.groupBy("task", "length").count()
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(
        runs.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))), "runs")
    # At most as many rows as there are lengths up to the capacity.
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = _slots(plan(counts, capacity))
    ranked = pieces.join(before.drop("count"), ["task", "length"])
    kept = [c for c in pieces.columns if c not in ("task", "place")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("place").to_numpy() + batch.column("before").to_numpy()
            key = (length << _RANK_BITS) + rank
            first, each, sequence, offset = slots[np.searchsorted(slots[:, 0], key, "right") - 1].T
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept),
                 pa.array(sequence + (key - first) // each), pa.array(offset + (key - first) % each * length)],
                names=[*kept, "sequence_id", "offset"])

    types = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id long, offset long"
    return ranked.mapInArrow(tidy(look_up), schema)
