"""Benchmark passages in documents through a distributed positional inverted index.

The index holds, for each term, the documents it stands in and its places there.
Only terms that the benchmark asks for are stored. A test window is looked up from
its rarest terms: their place lists, each moved by the term's place in the test
item, must meet at the same start. What meets is compared word by word with the
document's own words, which the index keeps for documents that hold a rare term.

Items are cut into windows of 13 words; an item of fewer words is one window. All
windows of an item that meet at one shift between document and item are tested
together, so a passage costs a few index rows, not one for each of its words.
A near match is a window whose rarest terms stand no more than ``slop`` words
further apart or closer than in the item and of which at least ``near_share`` of
the words stand in the stretch.

Defined cases: null or empty texts have no words and are never hit. Items without
words are skipped. Items of one id count as one item. Repeated documents are
judged each.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.text import RowKeys, alnum_words, documents_of, slices
from tillwork.sources.scratch import materialise

WINDOW = 13
RAREST = 2
SHARE = 20
# Terms sent to all tasks; a benchmark with more is filtered by a join instead.
MOST_SENT = 500_000
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text column, as ``alnum_words`` takes them."""
    lowered = F.translate(F.coalesce(text, F.lit("")), *_LOWER)
    return F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """``item`` (a number), ``item_id``, ``words``, ``width``."""
    words = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    keyed = words.select(
        F.xxhash64(F.col("item_id").cast("string"), F.array_join("words", " ")).alias("item"),
        "item_id", "words", F.least(F.size("words"), F.lit(window)).alias("width"))
    return materialise(keyed.dropDuplicates(["item", "item_id", "words"]), "items")


def _term_counts(docs: DataFrame, terms: DataFrame, sent: set[bytes] | None) -> DataFrame:
    """``term, n``: in how many documents each benchmark term stands (0 left out)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                words = set(alnum_words(text))
                seen.update(words if sent is None else words & sent)
            if sent is None:
                yield _counted(seen)
                seen.clear()
        yield _counted(seen)

    counts = documents_of(docs).mapInArrow(count, "term string, n long")
    if sent is None:
        counts = counts.join(terms, "term", "left_semi")
    return counts.groupBy("term").agg(F.sum("n").alias("n"))


def _counted(seen: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([t.decode("utf-8", "replace") for t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
        names=["term", "n"])


def _anchors(items: DataFrame, counts: DataFrame, rarest: int) -> DataFrame:
    """``item, start, term, place``: the rarest terms of each window and their places in the item.

    A window with a term that no document has is left out: it occurs nowhere.
    """
    places = items.select("item", "width", F.size("words").alias("size"), F.posexplode("words").alias("place", "term"))
    known = places.join(counts, "term", "left").select(
        "item", "width", "size", "place", "term", F.coalesce("n", F.lit(0)).alias("n"))
    starts = F.sequence(
        F.greatest(F.col("place") - F.col("width") + 1, F.lit(0)), F.least("place", F.col("size") - F.col("width")))
    windows = known.withColumn("start", F.explode(starts))
    order = Window.partitionBy("item", "start").orderBy("n", "place")
    ranked = windows.withColumn("rank", F.row_number().over(order)).withColumn(
        "least", F.min("n").over(Window.partitionBy("item", "start")))
    return ranked.where((F.col("rank") <= rarest) & (F.col("least") > 0)).select("item", "start", "term", "place")


INDEX = "row long, doc_id long, n_words long, words string, postings array<struct<term string, places array<int>>>"


def _index(docs: DataFrame, terms: DataFrame, sent: set[bytes] | None) -> DataFrame:
    """Documents with their place lists of the wanted terms, and their words where there are any."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = RowKeys()
        for batch in slices(batches, "text"):
            sizes, texts, postings = [], [], []
            for text in batch.column("text").to_pylist():
                words = alnum_words(text)
                found: dict[bytes, list[int]] = defaultdict(list)
                if sent is None or not sent.isdisjoint(words):
                    for place, word in enumerate(words):
                        if sent is None or word in sent:
                            found[word].append(place)
                sizes.append(len(words))
                texts.append(b" ".join(words).decode("utf-8", "replace") if found else None)
                postings.append([
                    {"term": t.decode("utf-8", "replace"), "places": p} for t, p in found.items()])
            kind = pa.list_(pa.struct([("term", pa.string()), ("places", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.take(len(sizes))), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(texts, pa.string()), pa.array(postings, kind)],
                names=["row", "doc_id", "n_words", "words", "postings"])

    return materialise(documents_of(docs).mapInArrow(post, INDEX), "index")


def _sent(terms: DataFrame) -> set[bytes] | None:
    """The terms themselves if they are few enough to be sent to all tasks."""
    if terms.limit(MOST_SENT + 1).count() > MOST_SENT:
        return None
    return {r["term"].encode() for r in terms.collect()}


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST,
    slop: int | None = None, near_share: float = 0.8,
) -> tuple[DataFrame, DataFrame]:
    """The index, and ``row, item_id, kind, first, last`` of what was found.

    ``kind`` is ``exact``: the words first..last of the document are a run of the
    item's words as long as a window or longer; or, if ``slop`` is given, ``near``.
    """
    items = _items(benchmark, window)
    terms = materialise(items.select(F.explode("words").alias("term")).distinct(), "terms")
    counts = materialise(_term_counts(docs, terms, _sent(terms)), "term-counts")
    anchors = materialise(_anchors(items, counts, rarest), "anchors")
    asked = anchors.select("term").distinct()
    index = _index(docs, asked, _sent(asked))

    postings = index.select("row", F.inline("postings")).select("row", "term", "places")
    wanted = anchors.select("item", "term", "place").distinct()
    if _sent(asked) is None:
        postings = postings.join(asked, "term", "left_semi")
    # One row for each document, item and shift: the item's places whose terms meet there.
    moved = postings.join(wanted, "term").select(
        "row", "item", "place", F.explode("places").alias("at")).withColumn("shift", F.col("at") - F.col("place"))
    needed = anchors.groupBy("item", "start").agg(F.sort_array(F.collect_set("place")).alias("need"))
    of_item = needed.groupBy("item").agg(F.collect_list(F.struct("start", "need")).alias("windows"))
    width = items.select("item", "item_id", F.col("words").alias("item_words"), "width")
    exact = _exact(moved, of_item, width, index)
    if slop is None:
        return index, exact
    return index, exact.unionByName(_near(moved, of_item, width, index, slop, near_share))


def _exact(moved: DataFrame, of_item: DataFrame, items: DataFrame, index: DataFrame) -> DataFrame:
    met = moved.groupBy("row", "item", "shift").agg(F.collect_set("place").alias("places"))
    candidates = met.join(of_item, "item").where(
        F.exists("windows", lambda w: F.size(F.array_except(w["need"], F.col("places"))) == 0)
    ).select("row", "item", "shift")
    texts = index.where("words IS NOT NULL").select("row", "words")
    found = candidates.join(items, "item").join(texts, "row")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            rows: list[tuple] = []
            for row, item_id, shift, item, width, text in zip(
                *(batch.column(c).to_pylist() for c in ("row", "item_id", "shift", "item_words", "width", "words")),
                strict=True,
            ):
                words = text.split(" ")
                begin, end = max(0, -shift), min(len(item), len(words) - shift)
                equal = np.zeros(max(end - begin, 0) + 2, bool)
                equal[1:-1] = [item[k] == words[k + shift] for k in range(begin, end)]
                edges = np.flatnonzero(equal[1:] != equal[:-1]) + begin + shift
                rows += [
                    (row, item_id, "exact", int(first), int(last) - 1)
                    for first, last in zip(edges[::2], edges[1::2], strict=True) if last - first >= width]
            yield _match_batch(rows, batch.schema.field("item_id").type)

    kind = dict(items.dtypes)["item_id"]
    return found.select("row", "item_id", "shift", "item_words", "width", "words").mapInArrow(
        compare, f"row long, item_id {kind}, kind string, first long, last long")


def _match_batch(rows: list[tuple], item_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = (pa.int64(), item_type, pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
        names=["row", "item_id", "kind", "first", "last"])


def _near(
    moved: DataFrame, of_item: DataFrame, items: DataFrame, index: DataFrame, slop: int, near_share: float,
) -> DataFrame:
    """Windows whose rarest terms meet within ``slop`` places but not as in the item."""
    # A shift belongs to its bin and the one before, so shifts within slop share a bin.
    bins = moved.withColumn("bin", F.explode(F.array(
        F.floor(F.col("shift") / (slop + 1)), F.floor(F.col("shift") / (slop + 1)) - 1)))
    met = bins.groupBy("row", "item", "bin").agg(
        F.collect_set("place").alias("places"), F.min("shift").alias("low"), F.max("shift").alias("high"))
    windows = met.join(of_item, "item").select("row", "item", "places", "low", "high", F.explode("windows").alias("w"))
    candidates = windows.where(
        (F.size(F.array_except(F.col("w.need"), F.col("places"))) == 0)
    ).select("row", "item", F.col("w.start").alias("start"), "low", "high").distinct()
    texts = index.where("words IS NOT NULL").select("row", F.split("words", " ").alias("words"))
    joined = candidates.join(items, "item").join(texts, "row")
    first = F.greatest(F.col("start") + F.col("low"), F.lit(0))
    last = F.least(F.col("start") + F.col("high") + F.col("width") - 1, F.size("words") - 1)
    window = F.slice("item_words", F.col("start") + 1, F.col("width"))
    stretch = F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + 1)
    held = F.size(F.filter(window, lambda w: F.array_contains(stretch, w)))
    return (
        joined.withColumn("first", first.cast("long")).withColumn("last", last.cast("long"))
        .where(held >= F.ceil(F.col("width") * near_share))
        .select("row", "item_id", F.lit("near").alias("kind"), "first", "last").distinct()
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Per row of ``docs``: words, words hit, items found, and whether it is contaminated.

    It is if a word is hit and ``share`` times the words hit are the words or more.
    """
    index, found = matches(docs, benchmark, window)
    found = materialise(found, "matches")
    # Stretches that overlap are joined before their words are counted.
    order = Window.partitionBy("row").orderBy("first", "last")
    upto = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("last") - F.greatest("first", F.coalesce(upto + 1, F.col("first"))) + 1, F.lit(0))
    stretches = found.select("row", "first", "last").distinct()
    hits = stretches.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    ids = found.select("row", F.col("item_id").cast("string").alias("item_id")).groupBy("row").agg(
        F.sort_array(F.collect_set("item_id")).alias("ids"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        index.select("row", "doc_id", "n_words").join(hits, "row", "left").join(ids, "row", "left")
        .select(
            "doc_id", "n_words", hit.alias("n_hit"),
            F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
            ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"))
    )
