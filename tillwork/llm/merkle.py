"""Fixity audit of archive replicas by Merkle trees.

Pages become WARC response records in a global order; each has a number and a byte
offset. A leaf is the SHA-256 of a record; a range of 64 records hashes its leaves
and its first offset in order, and 16 nodes make one above. Replicas are compared
from the root: only nodes that differ are opened, so an audit of equal replicas
reads two roots, and one with few faults a few branches.

A replica has numbers and offsets of its own. Before trees are compared, the records of
each of its pages move to the place that page has in the primary, so a record that is
missing or was put in changes its own branch and none behind it. In branches that differ, records
are compared by page and hash, never by number.

Everything is aggregation and joins. A node's children are at most 64, and no
payload is shuffled: only hashes, numbers and sizes leave the task that read a
record.

Defined cases: null urls and pages are empty. Repeated rows are records of their
own, numbered one after another. Records missing from a replica, or only there,
are faults. Several records of one page that have no equal in the other replica are taken
in their order: as many as both have are corrupt, the rest missing or extra. A null
page id is an id like others. Two empty replicas are equal. Columns that pages or manifests
have beside the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.sources.scratch import materialise

LEAVES = 64
FANOUT = 16


def warc_record(url: Column, payload: Column) -> Column:
    """A response record as bytes: header, payload, and the two line ends that close it."""
    body = F.coalesce(payload.cast("binary"), F.lit(b"").cast("binary"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n").cast("binary"))


def manifest(pages: DataFrame) -> DataFrame:
    """``record_no, page_id, offset, size, hash`` of every page, in a written table.

    The order is by page id, then by the record's hash; records are numbered and
    their sizes added up over all tasks by the totals of each.
    """
    record = warc_record(F.col("url"), F.col("html"))
    rows = pages.select(
        F.col("page_id"), F.octet_length(record).cast("long").alias("size"), F.sha2(record, 256).alias("hash"))
    ranged = materialise(
        rows.orderBy(F.col("page_id").asc_nulls_first(), "hash")
        .withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()),
        "records")
    totals = ranged.groupBy("task").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("place").alias("first"))
    # One row for each task of the sort.
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "task", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"))
    within = ranged.join(F.broadcast(before), "task").withColumn(
        "record_no", F.col("n_before") + F.col("place") - F.col("first"))
    # Offsets in ranges of the leaves' size: the sum of earlier ranges, then within the range.
    block = F.floor(F.col("record_no") / LEAVES)
    sized = within.withColumn("block", block)
    blocks = sized.groupBy("task", "block", "bytes_before").agg(F.sum("size").alias("bytes"))
    upto = Window.partitionBy("task").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "task", "block", (F.col("bytes_before") + F.coalesce(F.sum("bytes").over(upto), F.lit(0))).alias("start"))
    inside = Window.partitionBy("task", "block").orderBy("record_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sized.join(starts, ["task", "block"]).select(
        "record_no", "page_id", (F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("offset"),
        "size", "hash")
    return materialise(numbered, "manifest")


def _node(children: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(children), lambda c: F.concat_ws(
        ":", c["no"].cast("string"), c["hash"])), "|").cast("binary"), 256)


def tree(records: DataFrame) -> list[DataFrame]:
    """The nodes (``no, hash``) of each level, leaves' ranges first, the root last.

    ``records`` has ``record_no, offset, hash``.
    """
    leaf = F.struct(
        F.col("record_no").alias("no"), F.concat_ws("@", "hash", F.col("offset").cast("string")).alias("hash"))
    level = materialise(
        records.groupBy(F.floor(F.col("record_no") / LEAVES).alias("no")).agg(F.collect_list(leaf).alias("c"))
        .select("no", _node(F.col("c")).alias("hash")), "nodes")
    levels = [level]
    while level.agg(F.max("no")).first()[0]:
        child = F.struct("no", "hash")
        level = materialise(
            level.groupBy(F.floor(F.col("no") / FANOUT).alias("parent")).agg(F.collect_list(child).alias("c"))
            .select(F.col("parent").alias("no"), _node(F.col("c")).alias("hash")), "nodes")
        levels.append(level)
    return levels


def _differing(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose rows differ or are in one frame only."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*values).alias(name))

    return side(first, "_first").join(side(second, "_second"), keys, "full").where(
        ~F.col("_first").eqNullSafe(F.col("_second")))


def _same(first: DataFrame, second: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys``, nulls equal; ``first``'s keys are kept, where it has the row."""
    other = second.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in second.columns))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return first.join(other, on, how).drop(*(f"_{k}" for k in keys))


def _moved(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The replica with ``place`` and ``start``: number and offset as its pages have them in the primary.

    Pages the primary does not have come after its end.
    """
    def pages(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("page_id").agg(F.min("record_no").alias(f"{name}_no"), F.min("offset").alias(f"{name}_offset"))

    behind = primary.agg(
        F.coalesce(F.max("record_no") + 1, F.lit(0)).alias("no"),
        F.coalesce(F.max(F.col("offset") + F.col("size")), F.lit(0)).alias("offset")).first()
    moves = _same(pages(replica, "own"), pages(primary, "to"), ["page_id"], "left").select(
        "page_id", F.coalesce(F.col("to_no") - F.col("own_no"), F.lit(behind["no"])).alias("by"),
        F.coalesce(F.col("to_offset") - F.col("own_offset"), F.lit(behind["offset"])).alias("by_offset"))
    rows = replica.select("record_no", "page_id", "offset", "size", "hash")
    return materialise(_same(rows, moves, ["page_id"], "left").select(
        *rows.columns, (F.col("record_no") + F.col("by")).alias("place"),
        (F.col("offset") + F.col("by_offset")).alias("start")), "moved")


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``nth``, their number among those of equal ``keys``, by record number.

    Numbers are given over the sorted rows of all tasks, so many equal keys are no one task's work.
    """
    ordered = materialise(
        rows.orderBy(*(F.col(k).asc_nulls_first() for k in keys), "record_no")
        .withColumn("task", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "ordered")
    totals = ordered.groupBy("task").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    # One row for each task of the sort.
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("task", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("add"))
    numbered = ordered.join(F.broadcast(before), "task").select(*rows.columns, (F.col("row") + F.col("add")).alias("nth"))
    least = numbered.groupBy(*keys).agg(F.min("nth").alias("least"))
    return _same(numbered, least, keys, "left").withColumn("nth", F.col("nth") - F.col("least")).drop("least")


def _unequal(mine: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of each side that have no equal one, page and hash, on the other."""
    keys = ["page_id", "hash"]
    first, second = (materialise(_counted(df, keys), "counted") for df in (mine, other))
    return tuple(
        _same(a, b.select(*keys, "nth"), [*keys, "nth"], "left_anti").drop("nth")
        for a, b in ((first, second), (second, first)))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Faulty records: ``record_no, page_id, offset, size, status, primary_hash, replica_hash``.

    Both are manifests, each with numbers and offsets of its own. ``status`` is
    ``corrupt``, ``missing`` (from the replica) or ``extra``; number, offset and size
    are the primary's, for extra records the replica's.
    """
    moved = _moved(primary, replica)
    ours = tree(primary)
    theirs = tree(moved.select(F.col("place").alias("record_no"), F.col("start").alias("offset"), "hash"))
    # Trees of unequal height are compared from the lower one's top.
    height = min(len(ours), len(theirs))
    open_ = None
    for mine, other in zip(reversed(ours[:height]), reversed(theirs[:height]), strict=True):
        if open_ is not None:
            parents = open_.select(F.col("no").alias("parent"))
            mine, other = (
                df.withColumn("parent", F.floor(F.col("no") / FANOUT)).join(parents, "parent", "left_semi")
                for df in (mine, other))
        open_ = materialise(_differing(mine, other, ["no"], ["hash"]).select("no"), "open")
    blocks = open_.select(F.col("no").alias("block"))
    columns = ["record_no", "page_id", "offset", "size", "hash"]
    mine, other = (
        df.withColumn("block", F.floor(F.col(place) / LEAVES)).join(blocks, "block", "left_semi").select(*columns)
        for df, place in ((primary, "record_no"), (moved, "place")))
    first, second = (_counted(df, ["page_id"]) for df in _unequal(mine, other))
    found = F.struct("record_no", "page_id", "offset", "size", "hash")
    # Both sides' keys are kept, as a record may be on one only.
    faults = first.select("page_id", "nth", found.alias("_first")).join(
        second.select(F.col("page_id").alias("_page_id"), F.col("nth").alias("_nth"), found.alias("_second")),
        F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("nth") == F.col("_nth")), "full")
    status = F.when(F.col("_second").isNull(), "missing").when(F.col("_first").isNull(), "extra").otherwise("corrupt")
    known = F.coalesce("_first", "_second")
    return faults.select(
        *(known[c].alias(c) for c in columns[:-1]), status.alias("status"),
        F.col("_first.hash").alias("primary_hash"), F.col("_second.hash").alias("replica_hash"))
