"""Connected components of a link table by repeated contraction.

Each round every node points at the neighbour (or itself) with the lowest
pseudo-random rank of that round; the links are then rewritten to the nodes
pointed at. Random ranks shrink long chains as fast as stars, and every step is
a join or an aggregation with map-side combine, so a node with a third of all
links never has to be gathered in one task. Rounds are written to the shared
folder: nothing is collected but the number of links left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.sources.scratch import materialise


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for each id in ``links`` (columns ``a, b``, long).

    ``component`` is the smallest id reachable. Links in either direction,
    repeated links and links of an id with itself are allowed; null ends are not
    links. Ids without a link to another id are left out.
    """
    edges = materialise(_distinct(links.where("a IS NOT NULL AND b IS NOT NULL")), "links")
    low = None
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        level = len(levels)
        heads = _heads(edges, level)
        if low is not None:
            # Nodes that have no link left stay as the heads they are.
            heads = low.join(heads.drop("low"), "node", "left").select(
                "node", F.coalesce("head", "node").alias("head"), "low")
        heads = materialise(heads, "heads")
        levels.append(heads)
        low = heads.groupBy(F.col("head").alias("node")).agg(F.min("low").alias("low"))
        to_a = heads.select(F.col("node").alias("a"), F.col("head").alias("head_a"))
        to_b = heads.select(F.col("node").alias("b"), F.col("head").alias("head_b"))
        moved = edges.join(to_a, "a").join(to_b, "b").select(
            F.col("head_a").alias("a"), F.col("head_b").alias("b"))
        edges = materialise(_distinct(moved), "links")
    if low is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = low.withColumnRenamed("low", "component")
    for heads in reversed(levels):
        labels = heads.join(labels.withColumnRenamed("node", "head"), "head").select("node", "component")
    return materialise(labels.withColumnRenamed("node", "id"), "components")


def _distinct(links: DataFrame) -> DataFrame:
    return (
        links.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )


def _heads(edges: DataFrame, level: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    rank = F.struct(F.xxhash64(F.col("b"), F.lit(level)).alias("rank"), F.col("b").alias("head"))
    own = F.struct(F.xxhash64(F.col("a"), F.lit(level)).alias("rank"), F.col("a").alias("head"))
    best = both.groupBy(F.col("a").alias("a")).agg(F.min(rank).alias("best"))
    return best.select(
        F.col("a").alias("node"), F.least(F.col("best"), own)["head"].alias("head"),
        F.col("a").alias("low"))
