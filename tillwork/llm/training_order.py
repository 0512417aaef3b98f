"""Token sequences in a keyed random order, in shards of fixed stride.

Every piece of every document gets a number: the pieces before it in its split of a
file, and those of the splits before, in order of file and place. A keyed Feistel
network permutes the numbers below the next power of four; a number that lands
outside is sent through again until it is inside (cycle walking). So each piece has
its own slot below the count of pieces, found without a sort, a table or a random
number. The same key gives the same order again for the same files, however they are
split. Rows that are read from no file are numbered by the tasks they are in.

Slot ``s`` lies in shard ``s // per_shard``. Shards are range partitions of the
slots; a row is a block of ``per_block`` records of ``stride`` bytes each: length,
document id, piece number, then the ids as 16-bit (or, for larger vocabularies,
32-bit) numbers, padded with zeros. A reader that stopped at slot ``s`` goes on
at shard, block and byte that follow from ``s`` alone.

Defined cases: a null or empty text is its end id. Repeated rows are sequences
each. A null doc_id is stored as -1 and read as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.rank_bpe import encoder, vocabulary_size
from tillwork.llm.text import documents_of, slices, task_number, tidy
from tillwork.llm.tokens import VOCABULARY, with_ends
from tillwork.sources.scratch import new_path

SEQUENCE = 1024
PER_BLOCK = 64
PER_SHARD = 4096
KEY = 0x5DEECE66D
ROUNDS = 6
_ROWS = 1000
HEAD = np.dtype([("length", "<u4"), ("piece", "<u4"), ("doc_id", "<i8")])
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def permuted(numbers: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """The slot below ``count`` of each number below ``count``; one to one for any key."""
    half = np.uint64(max(1, ((count - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64((key * (2 * r + 1) + 0x632BE59BD9B4E019 * (r + 1)) % 2 ** 64) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            f = (right + k) * _MIX
            f = (f ^ (f >> np.uint64(29))) * _MIX2
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << half) | right

    slots = once(numbers.astype(np.uint64))
    while len(outside := np.flatnonzero(slots >= np.uint64(count))):
        slots[outside] = once(slots[outside])
    return slots.astype(np.int64)


RUN = ("file", "block", "task")
PIECES = "file string, block long, task long, place long, doc_id long, piece int, length int, ids binary"


def _with_places(docs: DataFrame) -> DataFrame:
    """The documents with the file and the start of the split that each is read from."""
    try:
        return documents_of(
            docs, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    except AnalysisException:  # no rows of files
        return documents_of(docs, F.lit("").alias("file"), F.lit(0).cast("long").alias("block"))


def _places(files: pa.Array, blocks: np.ndarray, pieces: np.ndarray, placed: dict[tuple[str, int], int]) -> np.ndarray:
    """The place of each piece in its run; ``placed`` counts what the runs have so far."""
    codes = files.dictionary_encode()
    of_file, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
    starts = np.flatnonzero(np.r_[True, (np.diff(of_file) != 0) | (np.diff(blocks) != 0)])
    sizes = np.add.reduceat(pieces, starts)
    before = []
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        run = names[of_file[start]], int(blocks[start])
        before.append(placed.get(run, 0))
        placed[run] = before[-1] + size
    return np.arange(sizes.sum()) + np.repeat(np.array(before) - np.cumsum(sizes) + sizes, sizes)


def _pieces(docs: DataFrame, size: int, vocabulary: str, id_type: str) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        placed: dict[tuple[str, int], int] = {}
        for batch in slices(batches, "text", 2_000_000):
            ids, ends = with_ends(*known.encode(batch.column("text").to_pylist()), 0)
            sizes = np.diff(ends, prepend=0)
            pieces = -(-sizes // size)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(sizes[owner] - number * size, size)
            begin = np.r_[0, ends[:-1]][owner] + number * size
            data = ids.astype(id_type)
            yield pa.RecordBatch.from_arrays([
                batch.column("file").take(pa.array(owner)), batch.column("block").take(pa.array(owner)),
                pa.array(np.full(len(owner), task_number()), pa.int64()),
                pa.array(_places(batch.column("file"), batch.column("block").to_numpy(), pieces, placed), pa.int64()),
                batch.column("doc_id").take(pa.array(owner)), pa.array(number, pa.int32()),
                pa.array(length, pa.int32()),
                pa.array([data[b:b + n].tobytes() for b, n in zip(begin.tolist(), length.tolist(), strict=True)], pa.binary()),
            ], names=[*RUN, "place", "doc_id", "piece", "length", "ids"])

    spark = docs.sparkSession
    path = new_path(spark, "sequences")
    _with_places(docs).mapInArrow(tidy(cut), PIECES).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(PIECES).parquet(path)


def write_shards(
    docs: DataFrame, path: str, size: int = SEQUENCE, key: int = KEY, vocabulary: str = VOCABULARY,
    id_type: str = "<u2", per_block: int = PER_BLOCK, per_shard: int = PER_SHARD,
) -> int:
    """Write the shards below ``path`` as rows ``shard, block, first_slot, records, payload``.

    Returns the number of sequences. A shard's rows are in order of its blocks.
    """
    if vocabulary_size(vocabulary) > 1 << 8 * np.dtype(id_type).itemsize:
        raise ValueError(f"the ids of {vocabulary} do not fit {id_type}")
    spark = docs.sparkSession
    pieces = _pieces(docs, size, vocabulary, id_type)
    # One row for each split of the documents' files.
    totals = pieces.groupBy(*RUN).count()
    earlier = Window.orderBy(*RUN).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*RUN, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    count = totals.agg(F.sum("count")).first()[0] or 0
    numbered = pieces.join(F.broadcast(before), list(RUN)).select("before", "place", "doc_id", "piece", "length", "ids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = permuted(batch.column("before").to_numpy() + batch.column("place").to_numpy(), count, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots // per_shard), pa.array(slots), *(batch.column(c) for c in ("doc_id", "piece", "length", "ids"))],
                names=["shard", "slot", "doc_id", "piece", "length", "ids"])

    width = np.dtype(id_type).itemsize
    stride = HEAD.itemsize + size * width

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of the last block so far, which may go on in the next batch.
        slots, rows = np.zeros(0, np.int64), np.zeros((0, stride), np.uint8)
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                slots = np.r_[slots, batch.column("slot").to_numpy()]
                rows = np.concatenate([rows, _records(batch, size * width, stride)])
                ends = np.flatnonzero(np.diff(slots // per_block)) + 1
                if len(ends):
                    yield _blocks(slots[:ends[-1]], rows[:ends[-1]], ends, per_block, per_shard)
                    slots, rows = slots[ends[-1]:], rows[ends[-1]:]
        if len(slots):
            yield _blocks(slots, rows, np.array([len(slots)]), per_block, per_shard)

    slotted = numbered.mapInArrow(tidy(place), "shard long, slot long, doc_id long, piece int, length int, ids binary")
    shards = max(1, -(-count // per_shard))
    # Ranges of shards, known without a sample of the rows.
    parts = min(shards, 20_000)
    dealt = slotted.repartitionById(parts, F.expr(f"int(shard * {parts} div {shards})")).sortWithinPartitions("slot")
    dealt.mapInArrow(tidy(blocks), "shard long, block long, first_slot long, records int, payload binary").write.option(
        "compression", "zstd").parquet(path)
    return count


def _records(batch: pa.RecordBatch, ids_bytes: int, stride: int) -> np.ndarray:
    """The records of a batch, a row of ``stride`` bytes each."""
    head = np.zeros(batch.num_rows, HEAD)
    for name in ("length", "piece"):
        head[name] = batch.column(name).to_numpy()
    head["doc_id"] = pc.fill_null(batch.column("doc_id"), -1).to_numpy()
    ids = batch.column("ids").to_pylist()
    rows = np.zeros((batch.num_rows, stride), np.uint8)
    rows[:, :HEAD.itemsize] = head.view(np.uint8).reshape(-1, HEAD.itemsize)
    filled = np.arange(ids_bytes) < np.fromiter(map(len, ids), np.int64, len(ids))[:, None]
    rows[:, HEAD.itemsize:][filled] = np.frombuffer(b"".join(ids), np.uint8)
    return rows


def _blocks(slots: np.ndarray, rows: np.ndarray, ends: np.ndarray, per_block: int, per_shard: int) -> pa.RecordBatch:
    """The blocks that end at ``ends``, one row each."""
    starts = np.r_[0, ends[:-1]]
    first = slots[starts]
    return pa.RecordBatch.from_arrays(
        [pa.array(first // per_shard), pa.array(first % per_shard // per_block), pa.array(first),
         pa.array((ends - starts).astype(np.int32)),
         pa.array([rows[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
        names=["shard", "block", "first_slot", "records", "payload"])


RECORDS = "slot long, shard long, byte_offset long, doc_id long, piece int, length int, ids_crc32 long"


def read_shards(shards: DataFrame, size: int = SEQUENCE, id_type: str = "<u2", per_shard: int = PER_SHARD,
                from_slot: int = 0, per_block: int = PER_BLOCK) -> DataFrame:
    """The records of written shards from ``from_slot`` on, read from their payload.

    ``byte_offset`` is the record's place in its shard; ``ids_crc32`` is over the
    ids as little-endian unsigned 32-bit numbers. Earlier shards and blocks are passed over by
    the files' own statistics.
    """
    stride = HEAD.itemsize + size * np.dtype(id_type).itemsize

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column("first_slot").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                skipped = max(0, from_slot - first)
                rows = np.frombuffer(payload, np.uint8).reshape(-1, stride)[skipped:]
                if len(rows):
                    yield _parsed(rows, first + skipped, id_type, per_shard, stride)

    later = shards.where((F.col("shard") >= from_slot // per_shard) & (F.col("first_slot") > from_slot - per_block))
    return later.select("first_slot", "payload").mapInArrow(tidy(parse), RECORDS)


def _parsed(rows: np.ndarray, first: int, id_type: str, per_shard: int, stride: int) -> pa.RecordBatch:
    head = np.ascontiguousarray(rows[:, :HEAD.itemsize]).view(HEAD)[:, 0]
    ids = np.ascontiguousarray(rows[:, HEAD.itemsize:]).view(id_type).astype("<u4")
    slots = first + np.arange(len(rows))
    lengths = head["length"].tolist()
    return pa.RecordBatch.from_arrays(
        [pa.array(slots), pa.array(slots // per_shard), pa.array(slots % per_shard * stride),
         pa.array(head["doc_id"], mask=head["doc_id"] == -1), pa.array(head["piece"].astype(np.int32)),
         pa.array(head["length"].astype(np.int32)),
         pa.array([zlib.crc32(row[:n]) for row, n in zip(ids, lengths, strict=True)], pa.int64())],
        names=[part.split()[0] for part in RECORDS.split(", ")])
