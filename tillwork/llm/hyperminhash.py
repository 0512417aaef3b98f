"""Near-duplicate documents by HyperMinHash sketches.

A document's distinct word shingles are hashed to 64 bits. Some bits choose a
bucket; a bucket keeps its lowest hash as 16 bits, the count of leading zeros (6
bits) and the next bits as mantissa (10 bits). A coarse sketch of 128 buckets finds
candidates: four registers side by side are one 64-bit band value, so a document
has 32. A fine sketch of 512 buckets estimates the similarity of candidates, less
the matches that chance explains, and what may reach the threshold is confirmed on
the full shingle sets.

Only links that change a component are looked for:

1. Documents with the same set are one class, whatever their number.
2. Each class is compared with three leaders of every band value it has: the
   smallest id and two by hash; of these, the ones its size allows and with which it
   agrees in two bands. That joins nearly all that belongs together.
3. Where a band value still holds several components, classes of different ones
   are compared in blocks of bounded size. Members of a pair that the sketches allow
   get their full sets; the pairs are confirmed inside the block, which gives only
   links that join components. So no table has a row for each pair.

Chance of missing a pair: a pair of similarity 0.8 agrees in a band of four
registers with 0.41 and so in none of 32 with 5e-8; the estimates may be five
standard deviations too low. A bucket's lowest hash is a draw without replacement
from the union, so for small sets the deviation is small.

Defined cases: with fewer words than a shingle has, the whole sequence is the one
shingle. Without words or text the set is empty and links with nothing. Rows of
one doc_id are one document for linking. A null doc_id links with nothing, has no
component and is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.components import components
from tillwork.llm.text import documents_of, slices, spaced_words, tidy
from tillwork.llm.wanted import with_ids
from tillwork.sources.scratch import materialise

COARSE, FINE = 7, 9
MANTISSA = 10
BAND = 4
WORDS = 5
PERCENT = 80
_BLOCK = 256
_BLOCK_SHINGLES = 1 << 20
_CACHE_WORDS = 200_000
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; one per task."""

    def __init__(self, words: int) -> None:
        self._words = words
        self._hash: dict[bytes, int] = {}

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if len(self._hash) > _CACHE_WORDS:
            self._hash.clear()
        known = self._hash
        for text in texts:
            words = spaced_words(text)
            for word in set(words):
                if word not in known:
                    known[word] = xxhash.xxh3_64_intdigest(word)
            yield self._set(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))

    def _set(self, hashes: np.ndarray) -> np.ndarray:
        width = min(self._words, len(hashes))
        if not width:
            return hashes
        count = len(hashes) - width + 1
        # The width goes in, so that a short text is no part of a longer one.
        shingles = np.full(count, width, np.uint64)
        for place in range(width):
            shingles = _mixed(shingles * _MIX[0] + hashes[place:place + count])
        return np.unique(shingles)


def registers(shingles: np.ndarray, bits: int) -> np.ndarray:
    """2 ** bits registers of 16 bits; 0 is an empty bucket, larger is a lower hash."""
    mixed = _mixed(shingles + _MIX[0])
    bucket = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    rest = (mixed << np.uint64(bits)) | np.uint64((1 << bits) - 1)
    lowest = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(lowest, bucket, rest)
    used = np.zeros(1 << bits, bool)
    used[bucket] = True
    # The exponent of the top 53 bits gives the leading zeros without a loop.
    zeros = np.minimum(53 - np.frexp((lowest >> np.uint64(11)).astype(np.float64))[1], 62)
    mantissa = (lowest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return np.where(used, ((zeros + 1).astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16), 0).astype("<u2")


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of sketches (row by row), and the buckets it rests on."""
    used = np.maximum(((a > 0) | (b > 0)).sum(-1), 1)
    equal = ((a == b) & (a > 0)).sum(-1)
    larger, smaller = np.maximum(size_a, size_b), np.maximum(np.minimum(size_a, size_b), 1)
    ratio = larger / smaller
    # Published constant: matches to be expected of unrelated sets, per bucket and mantissa value.
    chance = 0.169919 * a.shape[-1] / 2 ** MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip((equal - chance) / used, 0, 1), used


def _sizes_allow(size_a, size_b, percent: int) -> np.ndarray:
    return 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)


def _may_link(a, b, size_a, size_b, percent: int) -> np.ndarray:
    estimate, used = similarity(a, b, size_a, size_b)
    wanted = percent / 100
    # The union of a pair at the threshold, and how much of it the buckets do not show.
    union = np.maximum((size_a + size_b) / (1 + wanted), used + 1)
    unseen = (union - used) / (union - 1)
    margin = 5 * np.sqrt(wanted * (1 - wanted) / used * unseen) + 2 / used
    return _sizes_allow(size_a, size_b, percent) & (estimate >= wanted - margin)


def _matrix(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, 1 << bits)


SKETCHES = "doc_id long, n_shingles long, set_key binary, coarse binary, fine binary"


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Set size, a 128-bit key of the set and both sketches of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, "text"):
            sizes, keys, coarse, fine = [], [], [], []
            for found in shingler(batch.column("text").to_pylist()):
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                coarse.append(registers(found, COARSE).tobytes())
                fine.append(registers(found, FINE).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(coarse, pa.binary()), pa.array(fine, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "coarse", "fine"])

    return materialise(documents_of(docs).mapInArrow(tidy(sketch), SKETCHES), "sketches")


def _bands(classes: DataFrame) -> DataFrame:
    """``band, place, id, n_shingles``: a row for each band value of a class that is not empty."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _band_values(_matrix(batch.column("coarse"), COARSE))
            row, place = np.nonzero(values)
            ids, sizes = (batch.column(c).to_numpy() for c in ("id", "n_shingles"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[values != 0].view(np.int64)), pa.array(place.astype(np.int32)), pa.array(ids[row]),
                 pa.array(sizes[row])],
                names=["band", "place", "id", "n_shingles"])

    return classes.select("id", "n_shingles", "coarse").mapInArrow(
        tidy(emit), "band long, place int, id long, n_shingles long")


def _band_values(sketch: np.ndarray) -> np.ndarray:
    values = np.ascontiguousarray(sketch).view("<u8").reshape(len(sketch), -1)
    place = np.arange(1, values.shape[1] + 1, dtype=np.uint64) * _MIX[0]
    return np.where(values != 0, np.maximum(_mixed(values ^ place), np.uint64(1)), np.uint64(0))


def _leader_pairs(bands: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a class and a leader that sizes allow and that agree in two bands or more.

    A pair that agrees in one band only is left to the comparison across components.
    """
    member = F.struct("id", "n_shingles")
    leaders = [F.min(member).alias("smallest"), *(
        F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("rank"), member.alias("of")))["of"].alias(f"by_hash_{k}")
        for k in (1, 2))]
    values = materialise(bands.groupBy("band").agg(F.count("*").alias("n"), *leaders).where("n > 1"), "leaders")
    met = bands.join(values, "band").select(
        "place", "id", "n_shingles", F.explode(F.array("smallest", "by_hash_1", "by_hash_2")).alias("leader"))
    smaller, larger = F.least("n_shingles", "leader.n_shingles"), F.greatest("n_shingles", "leader.n_shingles")
    return met.where("id <> leader.id").where(100 * smaller >= percent * larger).groupBy(
        F.least("id", "leader.id").alias("a"), F.greatest("id", "leader.id").alias("b")).agg(
        F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("a", "b")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""
    def side(name: str) -> DataFrame:
        return classes.select(
            F.col("id").alias(name), F.col("n_shingles").alias(f"n_{name}"),
            F.col("fine").alias(f"r_{name}"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = _may_link(
                    _matrix(batch.column("r_a"), FINE), _matrix(batch.column("r_b"), FINE),
                    batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(tidy(keep), "a long, b long")


def _shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, shingles`` of the documents in ``ids`` (``doc_id``), in a written table."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, "text"):
            found = [s.tobytes() for s in shingler(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.binary())], names=["id", "shingles"])

    chosen = with_ids(documents_of(docs), ids, "doc_id")
    return materialise(chosen.mapInArrow(tidy(sets), "id long, shingles binary"), "shingle-sets")


def _set_of(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _linked(first: np.ndarray, second: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(first, second, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(first) + len(second) - common)


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                good.append(_linked(_set_of(x), _set_of(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = materialise(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = _shingle_sets(docs, materialise(ids, "pair-ids"), words)
    a, b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    tested = pairs.join(a, "a").join(b, "b").select("a", "b", "s_a", "s_b")
    return materialise(tested.mapInArrow(tidy(test), "a long, b long"), "links")


MEMBERS = "band long, place int, i int, j int, part int, id long, component long"


def _cells(rest: DataFrame) -> DataFrame:
    """The classes of each band value dealt into parts; a row for each cell that a class is in.

    A part has about 256 classes or a million shingles; two parts meet in one cell, so a
    cell's rows and their full sets are bounded however many classes the value has.
    """
    parts = F.ceil(F.greatest(F.col("n") / _BLOCK, F.col("shingles") / _BLOCK_SHINGLES)).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    return (
        rest.withColumn("parts", parts).withColumn("part", part)
        .withColumn("other", F.explode(others))
        .select(
            "band", "place", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
            "part", "id", "component", "n_shingles", "coarse", "fine")
    )


def _near_members(cells: DataFrame, percent: int) -> DataFrame:
    """The rows of each cell that sketches allow a link to another component's, each id once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches, ["band", "i", "j"]):
            near = np.zeros(cell.num_rows, bool)
            for x, y in _cell_pairs(cell, percent):
                near[x] = True
                near[y] = True
            rows = np.flatnonzero(near)
            if len(rows):
                rows = rows[np.unique(cell.column("id").to_numpy()[rows], return_index=True)[1]]
                yield from cell.select(part_names).take(rows).combine_chunks().to_batches()

    part_names = [part.split()[0] for part in MEMBERS.split(", ")]
    return _by_cell(cells).mapInArrow(tidy(compare), MEMBERS)


def _across(rest: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components that share a band value, as many as join them.

    Pairs are compared and confirmed cell by cell; a pair that shares several values is
    confirmed in the first of them only.
    """
    members = materialise(_near_members(_cells(rest), percent), "near-members")
    ids = materialise(members.select(F.col("id").alias("doc_id")).distinct(), "near-ids")
    # Rows that repeat an id and its text are one set.
    sets = _shingle_sets(docs, ids, words).repartition("id").dropDuplicates(["id", "shingles"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches, ["band", "i", "j"]):
            links = _joining(_sketched(cell), percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = _by_cell(members.join(sets, "id").select(*members.columns, "shingles"))
    return materialise(dealt.mapInArrow(tidy(confirm), "a long, b long"), "links")


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def _sketched(cell: pa.Table) -> pa.Table:
    """The cell with sizes and sketches of its full sets."""
    sets = [_set_of(x) for x in cell.column("shingles")]
    cell = cell.append_column("n_shingles", pa.array([len(x) for x in sets], pa.int64()))
    for name, bits in (("coarse", COARSE), ("fine", FINE)):
        cell = cell.append_column(name, pa.array([registers(x, bits).tobytes() for x in sets], pa.binary()))
    return cell


def _joining(cell: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links of the cell, less those between what others of it have joined."""
    ids, component = (cell.column(c).to_pylist() for c in ("id", "component"))
    sets = [_set_of(x) for x in cell.column("shingles")]
    above: dict[int, int] = {}

    def top(of: int) -> int:
        while (over := above.get(of, of)) != of:
            above[of] = above.get(over, over)
            of = over
        return of

    links = []
    for x, others in _cell_pairs(cell, percent):
        for y in others.tolist():
            p, q = top(component[x]), top(component[y])
            if p != q and _linked(sets[x], sets[y], percent):
                above[max(p, q)] = min(p, q)
                links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
    return links


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted stream, each whole."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(table.num_rows, bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(new)]
        for start, end in zip(starts, starts[1:], strict=False):
            yield table.slice(start, end - start)
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def _cell_pairs(cell: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """A row of the cell's first part and the rows of the second that its sketches allow a link with."""
    ids, component, part, size = (
        cell.column(c).to_numpy() for c in ("id", "component", "part", "n_shingles"))
    i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    if len(ids) < 2 or (component == component[0]).all():
        return
    coarse = _matrix(cell.column("coarse").combine_chunks(), COARSE)
    fine = _matrix(cell.column("fine").combine_chunks(), FINE)
    values = np.ascontiguousarray(coarse).view("<u8")
    place = cell.column("place")[0].as_py()
    earlier = values[:, :place]
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    for x in left.tolist():
        y = right[(component[right] != component[x]) & ((ids[right] > ids[x]) if i == j else True)]
        y = y[_sizes_allow(size[x], size[y], percent)]
        if len(y) and place:
            y = y[~((earlier[y] == earlier[x]) & (earlier[x] != 0)).any(1)]
        for sketch in (coarse, fine):
            if len(y):
                y = y[_may_link(sketch[x], sketch[y], size[x], size[y], percent)]
        if len(y):
            yield x, y


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    rows = sketches(docs, words)
    classes = materialise(
        rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(
            F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"),
            F.first("coarse").alias("coarse"), F.first("fine").alias("fine")),
        "classes")
    # A document id may stand in several rows, and so for several sets.
    alike = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").join(
        classes.select("set_key", "id"), "set_key").where("doc_id <> id").select(
        F.col("id").alias("a"), F.col("doc_id").alias("b"))
    
    bands = materialise(_bands(classes), "bands")
    near = _leader_pairs(bands, percent)
    links = _confirmed(_estimated(near, classes, percent), docs, words, percent)
    known = components(links)

    labelled = bands.join(known, "id", "left").select(
        "band", "place", "id", F.coalesce("component", "id").alias("component"), "n_shingles")
    open_ = labelled.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"),
        F.sum("n_shingles").alias("shingles"),
    ).where("low < high").select("band", "n", "shingles")
    rest = labelled.drop("n_shingles").join(open_, "band").join(classes.select("id", "n_shingles", "coarse", "fine"), "id")
    more = _across(rest, docs, words, percent)

    found = components(links.union(more).union(alike))
    labels = rows.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return labels.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
