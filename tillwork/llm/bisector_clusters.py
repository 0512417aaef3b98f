"""Centroid clustering of integer vectors by a bisector tournament.

For centroids i < j the points at least as near to i as to j lie on one side of their
bisector: ``2 (c_j - c_i) . x <= |c_j|^2 - |c_i|^2``. Normals and thresholds of all pairs
are whole numbers, made once in each task from the centroids. A vector goes through k - 1 of these
sign tests: the winner so far meets the next centroid and stays unless the test is positive, so
zero favours the smaller number. Only the distance to the last winner is computed.

Vectors are quantised and written once. A round is one pass over them: each task sums
its vectors per centroid, so k rows of it are shuffled, and the k new centroids go
through the driver. Everything is whole numbers, so results do not depend on the
order of rows or tasks.

Defined cases: vectors that are null, of another length, or with a component that is
null or not finite are left out. Repeated rows count each. With fewer vectors than k there
are as many centroids as vectors; an empty table gives no rows. Equal centroids leave
all but the smallest empty, and an empty one stays as it is. A component too large for exact
64-bit distances stops the job with a message.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.sources.scratch import materialise

CLUSTERS = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
START = "2:"
_TILE = 512
# Doubles hold whole numbers below this exactly.
_EXACT = 2 ** 52


def largest_component(dimensions: int) -> int:
    """The largest component for which tests and distances fit 64 bits."""
    return 2 ** ((62 - max(dimensions - 1, 1).bit_length()) // 2 - 1)


def quantised(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS,
    scale: int = SCALE,
) -> DataFrame:
    """``key`` and ``v``, the whole parts of ``scale`` times each component, of the usable vectors."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where((F.size(embedding) == dimensions) & F.coalesce(finite, F.lit(False)))
    limit = largest_component(dimensions)

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < limit, F.floor(scaled).cast("int")).otherwise(F.raise_error(
            F.lit(f"component too large: {scale} times it must be below {limit}")).cast("int"))

    return usable.select(F.col(key), F.transform(embedding, whole).alias("v"))


@dataclass(frozen=True)
class Bisectors:
    """Normal and threshold of each pair of centroids."""

    centroids: np.ndarray
    normals: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def of(cls, centroids: list[list[int]]) -> Bisectors:
        c = np.array(centroids, np.int64)
        squares = (c * c).sum(axis=1)
        return cls(c, 2 * (c[None] - c[:, None]), squares[None] - squares[:, None])

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row, by k - 1 sign tests."""
        normals, thresholds = self.normals, self.thresholds
        largest = int(np.abs(vectors).max(initial=0)) * int(np.abs(normals).max(initial=0)) * vectors.shape[1]
        if largest < _EXACT:
            # The same whole numbers, for which doubles multiply faster.
            vectors, normals = vectors.astype(np.float64), normals.astype(np.float64)
        winner = np.zeros(len(vectors), np.int64)
        for start in range(0, len(vectors), _TILE):
            rows, best = vectors[start:start + _TILE], winner[start:start + _TILE]
            for j in range(1, len(self.centroids)):
                side = np.einsum("nd,nd->n", rows, normals[best, j])
                best[side > thresholds[best, j]] = j
        return winner

    def distances(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Squared distance of each row to the centroid of its number."""
        apart = vectors - self.centroids[numbers]
        return np.einsum("nd,nd->n", apart, apart)


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)


def _first_centroids(vectors: DataFrame, key: str, clusters: int, start: str) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, at most ``clusters`` of them."""
    hashed = F.sha2(F.concat(F.lit(start), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(hashed.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return [r["v"] for r in rows]


def _sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of the vectors nearest to each centroid; a row per centroid."""
    dimensions = len(centroids[0])
    names = [f"s{d}" for d in range(dimensions)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors.of(centroids)
        totals = np.zeros((len(centroids), dimensions), np.int64)
        counts = np.zeros(len(centroids), np.int64)
        for batch in batches:
            rows = _matrix(batch, dimensions)
            numbers = bisectors.nearest(rows)
            order = np.argsort(numbers, kind="stable")
            present, first = np.unique(numbers[order], return_index=True)
            if len(present):
                totals[present] += np.add.reduceat(rows[order], first, axis=0)
            counts += np.bincount(numbers, minlength=len(centroids))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[used]), *(pa.array(totals[used, d]) for d in range(dimensions))],
            names=["cluster", "n", *names])

    schema = ", ".join(["cluster int", "n long", *(f"{s} long" for s in names)])
    rows = vectors.select("v").mapInArrow(add_up, schema).groupBy("cluster").agg(
        *(F.sum(c).alias(c) for c in ("n", *names))).collect()
    return {r["cluster"]: (r["n"], [r[s] for s in names]) for r in rows}


@dataclass(frozen=True)
class Clustering:
    """``centroids`` after the last round; ``members``: ``key``, ``cluster``, ``distance``, a written table."""

    centroids: list[list[int]]
    members: DataFrame


def cluster(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS,
    rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, start: str = START,
) -> Clustering:
    """Fit ``rounds`` rounds over all usable vectors, then give each its nearest centroid."""
    ready = materialise(quantised(vectors, key, embedding, dimensions, scale), "quantised")
    centroids = _first_centroids(ready, key, clusters, start)
    if not centroids:
        return Clustering([], ready.select(
            key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    for _ in range(rounds):
        centroids = [list(c) for c in centroids]
        for number, (count, sums) in _sums(ready, centroids).items():
            centroids[number] = [s // count for s in sums]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors.of(centroids)
        for batch in batches:
            rows = _matrix(batch, dimensions)
            numbers = bisectors.nearest(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(numbers.astype(np.int32)), pa.array(bisectors.distances(rows, numbers))],
                names=[key, "cluster", "distance"])

    kind = dict(ready.dtypes)[key]
    members = ready.mapInArrow(assign, f"`{key}` {kind}, cluster int, distance long")
    return Clustering(centroids, materialise(members, "clusters"))


def with_inertia(found: Clustering) -> DataFrame:
    """The members with ``cluster_inertia``, ``inertia`` and ``centroid``, the components of theirs."""
    members = found.members
    spark = members.sparkSession
    # A row per centroid.
    sums = {r["cluster"]: r["s"] for r in members.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    facts = spark.createDataFrame(
        [(c, s, total, found.centroids[c]) for c, s in sorted(sums.items())],
        "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    return members.join(F.broadcast(facts), "cluster")
