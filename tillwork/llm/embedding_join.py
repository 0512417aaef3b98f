"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of ``c`` or more lie within epsilon = sqrt(2 - 2c).
They are sorted by the grid cells of side epsilon that they fall into along the
leading principal axes. The sorted sequence is cut into intervals (tasks of the
sort, blocks in them, runs in those); two intervals whose boxes on the axes are
further apart than epsilon cannot hold a link and are skipped, first blocks, then
runs. Runs are compared by a matrix product: first over the leading axes and the
length of the rest, which bounds the cosine from above, and only where that bound
reaches the limit over all numbers.

The vectors are shuffled once, to sort them. A block travels as one row of bytes, and
every task reads a stretch of blocks for either side from the written table, so no
block is copied for the pairs it is in, and disk grows with the vectors, not with the
pairs. A task returns what it found as a count for each vector and a spanning forest
of all its links, so a group of ``m`` copies costs ``m`` rows a task. Equal vectors are
next to each other in the sequence, and those of a block are one class. Axes are those
of the covariance of all vectors; any axes give the same result.

Without structure on the leading axes nothing can be skipped and the work is the
square of the vectors; see the README for figures.

Vectors of different lengths never link; each length has axes, blocks and pairs of its
own, and so its own jobs.

Defined cases: vectors that are null, zero, or hold null or non-finite numbers link
with nothing, as do those without an id. Rows of one id count as vectors of their
own, but share a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.llm.components import components
from tillwork.llm.text import RowKeys, task_number
from tillwork.sources.scratch import materialise

COSINE = 0.9
AXES = 8
GRID_AXES = 4
BOUND_AXES = 31
BLOCK = 16_384
LEAST_BLOCK = 256
BLOCK_BYTES = 8 << 20
RUN = 256
BLOCKS_PER_TASK = 4
MOST_TASKS = 20_000
SIDE_BYTES = 64 << 20
MOST_COVARIANCE = 256
_SLACK = 1e-5
_CLOSE = 1e-4
_KEY_BITS = 20


class _Rows:
    """What a batch of rows holds: the ids, and which vectors can link."""

    def __init__(self, batch: pa.RecordBatch, kind: str) -> None:
        column, ids = batch.column("embedding"), batch.column("vec_id")
        self.ids = ids
        self.sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        # Null numbers become NaN.
        self._flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
        filled = self.sizes > 0
        squares = np.zeros(len(column))
        if filled.any():
            ends = np.cumsum(self.sizes)
            with np.errstate(all="ignore"):
                squares[filled] = np.add.reduceat(np.square(self._flat, dtype=np.float64), (ends - self.sizes)[filled])
        self.usable = ids.is_valid().to_numpy(zero_copy_only=False) & (squares > 0) & (squares < np.inf)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of the usable rows of one length."""
        taken = self.usable & (self.sizes == size)
        vectors = self._flat[np.repeat(taken, self.sizes)].reshape(-1, size)
        return self.ids.filter(pa.array(taken)).to_numpy(zero_copy_only=False).astype(np.int64), vectors


def _numbers(column: pa.Array, kind: str, size: int) -> np.ndarray:
    """The vectors of a column of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def principal_axes(rows: DataFrame, size: int, kind: str, axes: int = AXES) -> np.ndarray:
    """The leading principal axes (columns) of the unit vectors of one length.

    Of longer vectors only the first ``MOST_COVARIANCE`` coordinates are used. What
    is collected is one number for each two coordinates.
    """
    width = min(size, MOST_COVARIANCE)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            _, vectors = _Rows(batch, kind).of(size)
            if len(vectors):
                unit = _unit(vectors.astype(np.float64))[:, :width]
                unit = np.c_[unit, np.ones(len(unit))]
                total += unit.T @ unit
        row, column = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row.ravel()), pa.array(column.ravel()), pa.array(total.ravel())], names=["i", "j", "value"])

    added = rows.mapInArrow(sums, "i long, j long, value double")
    total = np.zeros((width + 1, width + 1))
    for i, j, value in added.groupBy("i", "j").agg(F.sum("value")).collect():
        total[i, j] = value
    count = max(total[-1, -1], 1)
    mean = total[-1, :-1] / count
    _, vectors = np.linalg.eigh(total[:-1, :-1] / count - np.outer(mean, mean))
    leading = np.zeros((size, min(axes, width)))
    leading[:width] = vectors[:, ::-1][:, :axes]
    return leading


PLACED = "vec_id long, vector binary, cell long, along double, same long, row long"
BLOCKS = "part long, block long, low array<double>, high array<double>, ids binary, copies binary, vectors binary"


def _block_rows(size: int, kind: str) -> int:
    return max(LEAST_BLOCK, min(BLOCK, BLOCK_BYTES // (size * np.dtype(kind).itemsize)))


def _blocks(rows: DataFrame, axes: np.ndarray, epsilon: float, kind: str, count: int) -> DataFrame:
    """The sequence in grid order, cut into blocks, in a written table."""
    size, each = len(axes), _block_rows(len(axes), kind)
    side = max(epsilon, 1e-3)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = RowKeys()
        for batch in batches:
            ids, vectors = _Rows(batch, kind).of(size)
            if not len(ids):
                continue
            vectors = vectors + vectors.dtype.type(0)  # one zero, not two
            # Rounded, as a product's last bits may differ between equal vectors.
            at = (_unit(vectors.astype(np.float64)) @ axes[:, :GRID_AXES]).astype(np.float32)
            cells = np.clip(np.floor(at / side), -(1 << 15), (1 << 15) - 1).astype(np.int64)
            cell = np.zeros(len(ids), np.int64)
            for k in range(cells.shape[1]):
                cell = (cell << 16) + cells[:, k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), _bytes(vectors), pa.array(cell), pa.array(at[:, 0].astype(np.float64)),
                 pa.array(_mixed(vectors)), pa.array(numbers.take(len(ids)))],
                names=["vec_id", "vector", "cell", "along", "same", "row"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = 0, None
        vectors, ids, copies = np.zeros((0, size), kind), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            more = _numbers(batch.column("vector"), kind, size)
            new = np.r_[last is None or (more[0] != last).any(), (more[1:] != more[:-1]).any(1)]
            last = more[-1]
            starts = np.flatnonzero(new)
            counts = np.diff(np.r_[starts, len(more)])
            if not new[0]:
                copies[-1] += starts[0] if len(starts) else len(more)
            vectors, copies = np.concatenate([vectors, more[new]]), np.concatenate([copies, counts])
            ids = np.concatenate([ids, batch.column("vec_id").to_numpy()])
            while len(copies) > each:
                held = int(copies[:each].sum())
                yield _block(vectors[:each], ids[:held], copies[:each], axes, number)
                vectors, ids, copies, number = vectors[each:], ids[held:], copies[each:], number + 1
        if len(copies):
            yield _block(vectors, ids, copies, axes, number)

    blocks = -(-count // each)
    tasks = min(max(min(blocks, 2 * BLOCKS_PER_TASK), -(-blocks // BLOCKS_PER_TASK)), MOST_TASKS)
    # Rows of one vector and id are alike; only their numbers let them be dealt out.
    order = ["cell", "along", "same", "vec_id", "row"]
    dealt = rows.mapInArrow(place, PLACED).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return materialise(dealt.coalesce(tasks).mapInArrow(cut, BLOCKS), "blocks")


def _bytes(vectors: np.ndarray) -> pa.Array:
    width = vectors.shape[1] * vectors.itemsize
    offsets = np.arange(0, (len(vectors) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(vectors))])


def _mixed(vectors: np.ndarray) -> np.ndarray:
    """A number for each vector; equal ones have the same."""
    words = np.ascontiguousarray(vectors).view(np.uint32)
    weights = np.random.default_rng(1).integers(1 << 63, size=words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        mixed += words[:, k] * weights[k]
    return mixed.view(np.int64)


def _block(vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray, axes: np.ndarray, number: int) -> pa.RecordBatch:
    at = _unit(vectors.astype(np.float64)) @ axes[:, :AXES]
    part = task_number()
    return pa.RecordBatch.from_arrays(
        [pa.array([part]), pa.array([(part << _KEY_BITS) + number]),
         pa.array([at.min(0)], pa.list_(pa.float64())), pa.array([at.max(0)], pa.list_(pa.float64())),
         pa.array([ids.astype("<i8").tobytes()], pa.binary()),
         pa.array([copies.astype("<i8").tobytes()], pa.binary()),
         pa.array([vectors.tobytes()], pa.binary())],
        names=["part", "block", "low", "high", "ids", "copies", "vectors"])


def _keys(block: int, count: int) -> np.ndarray:
    return (block << _KEY_BITS) + np.arange(count, dtype=np.int64)


def _members(blocks: DataFrame) -> DataFrame:
    """``key, vec_id, copies, first``: the rows of each class, and the first id of the class."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, copies = (np.frombuffer(batch.column(c)[k].as_py(), "<i8") for c in ("ids", "copies"))
                keys = _keys(batch.column("block")[k].as_py(), len(copies))
                first = ids[np.cumsum(copies) - copies]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(keys, copies)), pa.array(ids), pa.array(np.repeat(copies, copies)),
                     pa.array(np.repeat(first, copies))], names=["key", "vec_id", "copies", "first"])

    return blocks.select("block", "ids", "copies").mapInArrow(spread, "key long, vec_id long, copies long, first long")


def _within(epsilon: float, axes: int, a: str, b: str) -> Column:
    """Whether boxes ``a`` and ``b`` are at most epsilon apart."""
    apart = F.lit(0.0)
    for k in range(axes):
        gap = F.greatest(
            F.col(f"low_{b}")[k] - F.col(f"high_{a}")[k], F.col(f"low_{a}")[k] - F.col(f"high_{b}")[k], F.lit(0.0))
        apart = apart + gap * gap
    return apart <= epsilon * epsilon + _SLACK


def _meetings(blocks: DataFrame, epsilon: float, axes: int, stretches: int) -> DataFrame:
    """``ids_a, .. vectors_b``: blocks that may hold links, each pair once, the pairs of one ``a`` in sequence.

    Either side is read from the written table by each task, in so many stretches;
    a shuffle would write a block for every pair it is in.
    """
    def side(name: str) -> DataFrame:
        return blocks.select(F.col("block").alias(name), *(
            F.col(c).alias(f"{c}_{name}") for c in ("low", "high", "ids", "copies", "vectors"))).coalesce(stretches)

    # Either end of a pair may come first, so that tasks have about the same number.
    turn = F.pmod(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), F.lit(2)) == 0
    once = (F.col("a") == F.col("b")) | (turn & (F.col("a") < F.col("b"))) | (~turn & (F.col("a") > F.col("b")))
    met = side("a").hint("shuffle_replicate_nl").join(side("b"), once & _within(epsilon, axes, "a", "b"))
    return met.select("a", "b", *(f"{c}_{x}" for x in "ab" for c in ("ids", "copies", "vectors")))


class _Side:
    """A block in the task that compares it."""

    def __init__(self, block: int, ids: bytes, copies: bytes, vectors: bytes, kind: str, axes: np.ndarray) -> None:
        self.block = block
        self.copies = np.frombuffer(copies, "<i8")
        self.ids = np.frombuffer(ids, "<i8")[np.cumsum(self.copies) - self.copies]
        self.raw = np.frombuffer(vectors, kind).reshape(len(self.ids), -1)
        self.unit = _unit(self.raw).astype(np.float32, copy=False)
        self.starts = np.arange(0, len(self.ids), RUN)
        at = self.unit @ axes.astype(np.float32)
        self.low, self.high = (f.reduceat(at[:, :AXES], self.starts) for f in (np.minimum, np.maximum))
        # What is left beside the axes, never too short.
        rest = np.maximum(1 - np.einsum("ij,ij->i", at, at), 0) + _SLACK
        self.bound = np.c_[at, np.sqrt(rest)]


class _Trial:
    """Whether bounds are worth their products; a task leaves them out where most refuse nothing."""

    def __init__(self, size: int, axes: int) -> None:
        self.share = (axes + 1) / size
        self.tried, self.refused = 0, 0

    def worth(self) -> bool:
        return self.share < 1 and (self.tried < 64 or self.refused > self.share * self.tried)


def _runs(a: _Side, b: _Side, epsilon: float, cosine: float, trial: _Trial) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Runs of ``a`` and ``b`` that hold links, and which of their rows link; of one block each pair of runs once."""
    gap = np.maximum(np.maximum(b.low - a.high[:, None], a.low[:, None] - b.high), 0)
    near = (gap * gap).sum(2) <= epsilon * epsilon + _SLACK
    for i, j in zip(*np.nonzero(np.triu(near) if a is b else near), strict=True):
        rows, columns = slice(i * RUN, (i + 1) * RUN), slice(j * RUN, (j + 1) * RUN)
        if trial.worth():
            refused = (a.bound[rows] @ b.bound[columns].T).max() < cosine - _CLOSE
            trial.tried, trial.refused = trial.tried + 1, trial.refused + int(refused)
            if refused:
                continue
        # Single precision decides all but what is close to the limit.
        rough = a.unit[rows] @ b.unit[columns].T
        if rough.max() < cosine - _CLOSE:
            continue
        found = rough >= cosine
        for m, n in zip(*np.nonzero(np.abs(rough - cosine) <= _CLOSE), strict=True):
            u, v = (x.astype(np.float64) for x in (a.raw[rows][m], b.raw[columns][n]))
            found[m, n] = u @ v / (math.sqrt(u @ u) * math.sqrt(v @ v)) >= cosine or (u == v).all()
        if a is b and i == j:
            np.fill_diagonal(found, False)
        if found.any():
            yield rows, columns, found


def _forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Rows and columns of a spanning forest of the links."""
    rows, columns = [], []
    open_row, open_column = linked.any(1), linked.any(0)
    while open_row.any():
        frontier = np.flatnonzero(open_row)[:1]
        open_row[frontier] = False
        while len(frontier):
            reached = np.flatnonzero(linked[frontier].any(0) & open_column)
            rows += frontier[linked[np.ix_(frontier, reached)].argmax(0)].tolist() if len(reached) else []
            columns += reached.tolist()
            open_column[reached] = False
            frontier = np.flatnonzero(linked[:, reached].any(1) & open_row) if len(reached) else reached
            if len(frontier):
                columns += reached[linked[np.ix_(frontier, reached)].argmax(1)].tolist()
                rows += frontier.tolist()
                open_row[frontier] = False
    return rows, columns


class _Joined:
    """Which classes the links of a task join."""

    def __init__(self) -> None:
        self.parent = np.zeros(0, np.int64)
        self.place: dict[int, int] = {}

    def roots(self, side: _Side) -> np.ndarray:
        """For each class of the block a number that joined classes share."""
        if side.block not in self.place:
            self.place[side.block] = len(self.parent)
            self.parent = np.r_[self.parent, np.arange(len(self.parent), len(self.parent) + len(side.ids))]
        own = slice(self.place[side.block], self.place[side.block] + len(side.ids))
        found = self.parent[own]
        while True:
            above = self.parent[found]
            if (above == found).all():
                self.parent[own] = found
                return found
            found = above

    def join(self, a: int, b: int) -> bool:
        """Join what two numbers stand for; false if it was joined before."""
        while (above := self.parent[a]) != a:
            a = above
        while (above := self.parent[b]) != b:
            b = above
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def links(self, a: _Side, b: _Side, rows: slice, columns: slice, linked: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ids of the links that join what was not joined before."""
        x, y = self.roots(a)[rows], self.roots(b)[columns]
        met = np.concatenate([x[linked.any(1)], y[linked.any(0)]])
        if (met == met[0]).all():
            return
        for m, n in zip(*_forest(linked), strict=True):
            if self.join(x[m], y[n]):
                yield a.ids[rows][m], b.ids[columns][n]


FOUND = "key long, n long, a long, b long"


def _compared(blocks: DataFrame, axes: np.ndarray, epsilon: float, cosine: float, kind: str) -> DataFrame:
    """Rows of (key, n): links of a class found here, and of (a, b): links that join ids."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trial, joined, a = _Trial(*axes.shape), _Joined(), None
        counts: dict[int, np.ndarray] = {}
        links: list[tuple[int, int]] = []
        for batch in batches:
            for k in range(batch.num_rows):
                def side(x: str, batch: pa.RecordBatch = batch, k: int = k) -> _Side:
                    return _Side(batch.column(x)[k].as_py(), *(
                        batch.column(f"{c}_{x}")[k].as_buffer() for c in ("ids", "copies", "vectors")), kind, axes)

                if a is None or a.block != batch.column("a")[k].as_py():
                    a = side("a")
                b = a if a.block == batch.column("b")[k].as_py() else side("b")
                for rows, columns, linked in _runs(a, b, epsilon, cosine, trial):
                    for x in (a, b):
                        counts.setdefault(x.block, np.zeros(len(x.ids), np.int64))
                    counts[a.block][rows] += linked @ b.copies[columns]
                    if a is not b or rows != columns:
                        counts[b.block][columns] += a.copies[rows] @ linked
                    links += joined.links(a, b, rows, columns, linked)
        for block, count in counts.items():
            some, none = np.flatnonzero(count), pa.nulls(int((count > 0).sum()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(_keys(block, len(count))[some]), pa.array(count[some]), none, none], names=["key", "n", "a", "b"])
        if links:
            none = pa.nulls(len(links), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, *(pa.array(np.array(ends, np.int64)) for ends in zip(*links, strict=True))],
                names=["key", "n", "a", "b"])

    held, each = blocks.count(), _block_rows(len(axes), kind) * len(axes) * np.dtype(kind).itemsize
    stretches = max(1, min(16, held), -(-held * each // SIDE_BYTES))
    met = _meetings(blocks, epsilon, min(AXES, axes.shape[1]), stretches)
    return materialise(met.mapInArrow(compare, FOUND), "compared")


def similar_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row with ``vec_id, embedding``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kind = "<f4" if rows.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = _Rows(batch, kind)
            size, count = np.unique(read.sizes[read.usable], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(count)], names=["size", "n"])

    # A row for each length; a length that one vector has alone links with nothing.
    sizes = {r["size"]: r["count"] for r in rows.mapInArrow(lengths, "size long, n long").groupBy("size").agg(
        F.sum("n").alias("count")).where("count > 1").orderBy("size").collect()}
    if not sizes:
        return rows.select("vec_id", *_labels(F.lit(0), F.lit(None)))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = _Rows(batch, kind)
            left = ~(read.usable & np.isin(read.sizes, list(sizes)))
            yield pa.RecordBatch.from_arrays([read.ids.filter(pa.array(left))], names=["vec_id"])

    counted, linked = rows.mapInArrow(alone, "vec_id long").withColumn("n_links", F.lit(0).cast("long")), None
    for size, count in sizes.items():
        counts, links = _of_length(rows, size, count, cosine, kind)
        counted = counted.union(counts)
        linked = links if linked is None else linked.union(links)
    groups = components(linked)
    labelled = counted.join(groups.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return labelled.select("vec_id", *_labels(F.col("n_links"), F.col("component")))


def _of_length(rows: DataFrame, size: int, count: int, cosine: float, kind: str) -> tuple[DataFrame, DataFrame]:
    """Links of each vector of one length (``vec_id, n_links``), and links that join ids (``a, b``)."""
    epsilon = math.sqrt(max(2 - 2 * cosine, 0))
    axes = principal_axes(rows, size, kind, BOUND_AXES)
    blocks = _blocks(rows, axes, epsilon, kind, count)
    found = _compared(blocks, axes, epsilon, cosine, kind)
    members = _members(blocks)
    links = found.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"))
    counted = members.join(links, "key", "left").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    copies = members.where("copies > 1").select(F.col("first").alias("a"), F.col("vec_id").alias("b"))
    return counted, found.where("a IS NOT NULL").select("a", "b").union(copies)


def _labels(links: Column, component: Column) -> list[Column]:
    smallest = F.coalesce(component.cast("long"), F.col("vec_id"))
    return [
        links.cast("long").alias("n_links"), smallest.alias("component_id"),
        F.coalesce(F.col("vec_id") == smallest, F.lit(True)).alias("kept")]
