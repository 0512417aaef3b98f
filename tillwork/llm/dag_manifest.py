"""Merkle manifest of a document table as a content-addressed graph.

A leaf is the SHA-256 of a row's fields. The leaves of one language, in order of
their ids, are hashed eight at a time into nodes, those again, until one is left:
the language's subroot. The subroots, in order of the languages, make the root in the
same way. The store maps the digest of a node to the digests of its children.

Leaf requests descend from the root: at each node the next octal digit of the
wanted rank selects a child, and the children not selected are collected as one
segment of the path. Requests that share a node descend together, so a step joins each
node with its record once, whatever number of leaves lies below it; they part where
their digits do. Reversed, the segments are the path from the leaf to the root.

Ranks are found by a range sort and the counts of its tasks, so a language with most
of the rows is spread like any other. A node has at most eight children; no group
is larger. Only digests, ids and languages are shuffled, never texts.

Defined cases: a null field is ``-``. A null language comes first; so does a null id
within its language, and it is never taken for tampered. Repeated rows are leaves each, rows of
one id are ordered by digest. A language with one row has its leaf as subroot, one
language alone its subroot as root, an empty table no root and no proofs. Columns other than those hashed
are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.sources.scratch import materialise

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "struct<left:string,right:string>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    """SHA-256, in lower-case hex, of the parts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def stated(value: Column) -> Column:
    """A field as it is hashed: ``-``, or its length in bytes and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(docs: DataFrame, **instead: Column) -> Column:
    """The leaf of a row; ``instead`` replaces fields by other values."""
    return digest(*(stated(instead.get(name, docs[name])) for name in FIELDS))


def lower_cased(text: Column) -> Column:
    """``text`` with A-Z in lower case."""
    return F.translate(text, _UPPER, _UPPER.lower())


@dataclass(frozen=True)
class Manifest:
    """``trees``: a row per language (``tree, tree_no, n, height, subroot``); ``runs``: the lowest
    nodes with their leaves (``members``); ``store``: per height, digest to children."""

    root: str | None
    top_height: int
    heights: list[int]
    trees: DataFrame
    runs: DataFrame
    store: dict[int, DataFrame]
    top_store: dict[int, DataFrame]


def numbered(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Add ``no``, the place within its ``tree`` from 0, and ``n``, the tree's rows."""
    ranged = materialise(
        rows.orderBy(tree, *order).withColumn("_task", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id()), "ranged")
    counts = ranged.groupBy(tree, "_task").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    # A row for each task of the sort and each tree.
    earlier = Window.partitionBy(tree).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(counts.select(
        tree, "_task", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy(tree)).alias("n")), "ranks")
    return ranged.join(before, [tree, "_task"]).withColumn("no", F.col("_place") + F.col("_shift")).drop(
        "_task", "_place", "_shift")


def _parent(no: Column) -> Column:
    return F.shiftright(no, 3)


def _runs(nodes: DataFrame, *members: str) -> DataFrame:
    """Eight consecutive nodes of a tree in one row: ``tree, n, no, members``, in order."""
    return nodes.groupBy("tree", "n", _parent(F.col("no")).alias("no")).agg(
        F.array_sort(F.collect_list(F.struct("no", *members))).alias("members"))


def _grow(level: DataFrame, height: int, most: int) -> dict[int, DataFrame]:
    """The levels above ``level``, which is at ``height``: tables of ``tree, n, no, digest, children``."""
    levels = {}
    while most > FANOUT ** height:
        runs = _runs(level.where(F.col("n") > FANOUT ** height), "digest")
        children = F.col("members.digest")
        height += 1
        level = levels[height] = materialise(runs.select(
            "tree", "n", "no", digest(F.array_join(children, "")).alias("digest"), children.alias("children")),
            f"level-{height}")
    return levels


def _tops(levels: dict[int, DataFrame]) -> DataFrame:
    """The last node of each tree: ``tree, n, height, subroot``."""
    tops = None
    for height, level in levels.items():
        # The trees that end at this height.
        at = level.where((F.col("n") <= FANOUT ** height) & (F.col("n") > (FANOUT ** (height - 1) if height > 1 else 0)))
        rows = at.select("tree", "n", F.lit(height).alias("height"), F.col("digest").alias("subroot"))
        tops = rows if tops is None else tops.unionByName(rows)
    return tops


def _records(levels: dict[int, DataFrame]) -> dict[int, DataFrame]:
    """One record for each digest, as equal nodes share one."""
    return {h: level.groupBy("digest").agg(F.first("children").alias("children")) for h, level in levels.items()}


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves``: ``doc_id``, ``lang``, ``leaf``, and any further columns, which its members keep.

    Languages are trees under their own name behind ``=``, the null one under the empty name.
    """
    also = [c for c in leaves.columns if c not in ("lang", "tree")]
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree")
    # Written before the sort, which reads its input twice.
    hashed = materialise(leaves.select(tree, *also), "leaves")
    ranked = numbered(hashed, "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    whole = F.array_join(F.col("members.leaf"), "")
    runs = materialise(_runs(ranked, *also).select(
        "tree", "n", "no", "members",
        F.when(F.col("n") == 1, whole).otherwise(digest(whole)).alias("digest")), "runs")
    most = runs.agg(F.max("n")).first()[0]
    if most is None:
        trees = runs.select("tree", F.lit(0).alias("tree_no"), "n", F.lit(1).alias("height"), F.lit("").alias("subroot"))
        return Manifest(None, 0, [], trees, runs, {}, {})
    levels = _grow(runs, 1, most)
    ends = _tops({1: runs, **levels}).withColumns({"of": F.col("tree"), "tree": F.lit("")})
    placed = materialise(numbered(ends.withColumnRenamed("n", "rows"), "tree", [F.col("of")]), "trees")
    trees = placed.select(
        F.col("of").alias("tree"), F.col("no").alias("tree_no"), F.col("rows").alias("n"), "height", "subroot")
    heights = [r["height"] for r in trees.select("height").distinct().collect()]  # a dozen at most
    count = placed.agg(F.max("n")).first()[0]
    above = _grow(placed.select("tree", "n", "no", F.col("subroot").alias("digest")), 0, count)
    root = (above[max(above)].select("digest") if above else trees.select("subroot")).first()[0]
    return Manifest(root, max(above, default=0), heights, trees, runs, _records(levels), _records(above))


def _step(open_: DataFrame, store: DataFrame) -> DataFrame:
    """From nodes to their children: the digit chosen joins ``no``, the others join ``path``."""
    kept = [c for c in open_.columns if c not in ("digest", "no", "path")]
    met = open_.join(store, "digest")
    chosen = met.select(*kept, "no", "path", "children", F.posexplode("children").alias("digit", "digest"))
    return chosen.select(
        *kept, "digest", (F.shiftleft(F.col("no"), 3) + F.col("digit")).alias("no"),
        F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"))


def _segment(children: Column, digit: Column) -> Column:
    """The children before and behind the selected one."""
    return F.struct(
        F.array_join(F.slice(children, F.lit(1), digit), "").alias("left"),
        F.array_join(F.slice(children, digit + 2, F.lit(FANOUT)), "").alias("right"))


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """Path of every leaf, or of the leaves of the ``doc_id`` in ``wanted``.

    A row has the leaf's members as given to ``build``, ``subroot``, ``root`` and
    ``path``: from the leaf up, the digests left and right of it among its siblings.
    """
    runs = manifest.runs
    asked = None
    if wanted is not None:
        ids = wanted.select("doc_id").distinct()
        member = runs.select("tree", F.explode("members").alias("m")).select("tree", "m.no", "m.doc_id")
        asked = materialise(member.join(ids, "doc_id", "left_semi").select("tree", "no"), "asked")
    if manifest.root is None:
        empty = runs.select("tree", "n", "no", "members", F.lit("").alias("subroot"),
                            F.array().cast(f"array<{SEGMENT}>").alias("path"))
        return _leaves(empty, "", asked)
    spark = runs.sparkSession
    open_ = spark.createDataFrame([(manifest.root, 0)], "digest string, no long").withColumn(
        "path", F.array().cast(f"array<{SEGMENT}>"))
    for height in range(manifest.top_height, 0, -1):
        open_ = _step(open_, manifest.top_store[height])
    # A row for each language.
    open_ = open_.withColumnRenamed("no", "tree_no").join(
        manifest.trees.drop("n"), "tree_no").drop("tree_no").withColumn("no", F.lit(0).cast("long"))
    arrived = []
    heights = manifest.heights
    while True:
        if asked is not None:
            # The leading digits of the ranks asked for, as many as steps were taken.
            steps = len(arrived)
            nodes = asked.join(manifest.trees.select("tree", F.col("height").alias("top")), "tree").where(
                F.col("top") > steps)
            nodes = nodes.select("tree", F.expr(f"shiftright(no, 3 * (top - {steps}))").alias("no")).distinct()
            open_ = open_.join(nodes, ["tree", "no"], "left_semi")
        open_ = materialise(open_, "descent")
        arrived.append(open_.where(F.col("height") == 1))
        deeper = [h for h in heights if h > 1]
        if not deeper:
            break
        store = None
        for height in deeper:
            records = manifest.store[height].withColumn("height", F.lit(height))
            store = records if store is None else store.unionByName(records)
        step = _step(open_.where(F.col("height") > 1), store.drop("height"))
        open_ = step.withColumn("height", F.col("height") - 1)
        heights = [h - 1 for h in deeper]
    found = arrived[0]
    for more in arrived[1:]:
        found = found.unionByName(more)
    met = runs.join(found.drop("digest", "height"), ["tree", "no"])
    return _leaves(met, manifest.root, asked)


def _leaves(met: DataFrame, root: str, asked: DataFrame | None) -> DataFrame:
    """From the lowest nodes to their leaves, and the paths turned round."""
    leaves = met.select("tree", "n", "subroot", "path", "members", F.posexplode("members").alias("digit", "member"))
    own = F.when(F.col("n") > 1, F.array(_segment(F.col("members.leaf"), F.col("digit")))).otherwise(
        F.array().cast(f"array<{SEGMENT}>"))
    rows = leaves.select(
        "tree", "member.*", "subroot", F.lit(root).alias("root"), F.concat(own, F.reverse("path")).alias("path"))
    if asked is not None:
        rows = rows.join(asked, ["tree", "no"], "left_semi")
    return rows.drop("tree", "no")


def siblings_of(path: Column) -> Column:
    """All digests of a path, from the leaf's siblings up, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))
