"""Products bought together.

Both operators drop items below the least support first. An item in at least a
share s of the baskets is one of at most (mean basket size / s) items, so the
item set kept per basket has that bound, however many sales a basket holds.
No frequent set holds an infrequent item, so nothing is lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.measures import ratio
from tillwork.sources.scratch import materialise


@dataclass(frozen=True)
class FrequentSets:
    """Baskets reduced to their frequent items."""

    baskets: int
    min_count: int
    pairs: DataFrame  # basket, item: each once, infrequent items too
    items: DataFrame  # item, item_count
    sets: DataFrame  # basket, items: baskets with at least one frequent item


def frequent_sets(sales: DataFrame, basket: str, item: str, min_support: float) -> FrequentSets:
    if not 0 < min_support <= 1:
        raise ValueError("min_support must be above 0 and at most 1")
    pairs = (
        sales.select(F.col(basket).alias("basket"), F.col(item).alias("item"))
        .dropna().distinct()
    )
    pairs = materialise(pairs, "basket-items")
    baskets = pairs.agg(F.count_distinct("basket")).first()[0]
    min_count = max(math.ceil(min_support * baskets - 1e-9), 1)
    items = (
        pairs.groupBy("item").agg(F.count(F.lit(1)).alias("item_count"))
        .where(F.col("item_count") >= min_count)
    )
    sets = (
        pairs.join(items.select("item"), "item", "left_semi")
        .groupBy("basket").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return FrequentSets(baskets, min_count, pairs, items, sets)


def frequent_itemsets(found: FrequentSets) -> DataFrame:
    """``items, times``: every set of items in at least ``min_count`` baskets, of any size.

    Baskets with the same frequent items are counted together. A set grows by the
    items behind its last one in the basket, of those that also made a frequent set
    of the one before it. Each size reads the rows of the one below and counts its
    sets where they are made, so a task holds no basket or tree but the row at hand.
    Meanwhile an item is its place in the sorted list of frequent items, which the
    least support bounds.
    """
    names = found.items.agg(F.sort_array(F.collect_list("item")).alias("names"))
    coded = materialise(
        found.items.crossJoin(F.broadcast(names)).select(
            "item", F.array_position("names", F.col("item")).cast("int").alias("code"), F.col("item_count").alias("times")),
        "item-codes")
    sets = every = coded.select(F.array("code").alias("codes"), "times")
    weighted = (
        found.pairs.join(F.broadcast(coded), "item").groupBy("basket").agg(F.sort_array(F.collect_list("code")).alias("rest"))
        .where("size(rest) > 1").groupBy("rest").agg(F.count(F.lit(1)).alias("baskets"))
    )
    # A frequent set in a basket, and the basket's items that may come behind it.
    grown = materialise(weighted.select(F.expr("CAST(array() AS array<int>)").alias("codes"), "rest", "baskets"), "grown")
    while not grown.isEmpty():
        grown = _longer(grown, sets)
        sets = materialise(
            grown.select("codes", F.explode("rest").alias("code"), "baskets").groupBy("codes", "code")
            .agg(F.sum("baskets").alias("times")).where(F.col("times") >= found.min_count)
            .select(F.concat("codes", F.array("code")).alias("codes"), "times"),
            "item-sets")
        every = every.union(sets)
    named = F.transform("codes", lambda code: F.element_at("names", code))
    return every.crossJoin(F.broadcast(names)).select(named.alias("items"), "times")


def _longer(grown: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``grown`` with one more item, where that is one of the frequent ``sets``."""
    shorter = F.slice("codes", F.lit(1), F.size("codes") - 1)
    nexts = sets.select(shorter.alias("codes"), F.element_at("codes", -1).alias("next")).groupBy("codes").agg(
        F.collect_list("next").alias("nexts"))
    kept = grown.join(nexts, "codes").select("codes", F.array_intersect("rest", "nexts").alias("rest"), "baskets")
    longer = kept.select("codes", "rest", "baskets", F.posexplode("rest").alias("place", "code"))
    # The last item has none behind it.
    return materialise(longer.where(F.col("place") + 1 < F.size("rest")).select(
        F.concat("codes", F.array("code")).alias("codes"),
        F.slice("rest", F.col("place") + 2, F.size("rest")).alias("rest"), "baskets"), "grown")


def market_basket_rules(
    sales: DataFrame,
    basket: str = "order_id",
    item: str = "product_name",
    min_support: float = 0.003,
    min_confidence: float = 0.05,
) -> DataFrame:
    """Rules "who buys these also buys that" with support, confidence and lift."""
    found = frequent_sets(sales, basket, item, min_support)
    sets = frequent_itemsets(found)
    parts = sets.where("size(items) > 1").select("items", "times", F.explode("items").alias("bought")).select(
        F.array_except("items", F.array("bought")).alias("items"), "bought", F.col("times").alias("both"))
    single = found.items.select(F.col("item").alias("bought"), "item_count")
    confidence = ratio(F.col("both"), F.col("times"))
    everyone = F.lit(found.baskets)
    return parts.join(sets, "items").join(single, "bought").where(confidence >= min_confidence).select(
        F.array_join("items", " + ").alias("antecedent"),
        F.col("bought").alias("consequent"),
        ratio(F.col("both"), everyone).alias("support"),
        confidence.alias("confidence"),
        (confidence / ratio(F.col("item_count"), everyone)).alias("lift"))


def cross_sell_pairs(
    sales: DataFrame,
    basket: str = "customer_id",
    item: str = "product_category",
    *,
    min_support: float,
) -> DataFrame:
    """For items A and B: the share of A's buyers who buy B, and its lift.

    Pairs of less support than ``min_support`` are left out; it also bounds their number.

    Buyers with the same set of items are counted together first, and only the
    distinct sets are turned into pairs.
    """
    found = frequent_sets(sales, basket, item, min_support)
    weighted = found.sets.groupBy("items").agg(F.count(F.lit(1)).alias("buyers"))
    together = (
        weighted.withColumn("item_a", F.explode("items"))
        .withColumn("item_b", F.explode(F.array_remove("items", F.col("item_a"))))
        .groupBy("item_a", "item_b").agg(F.sum("buyers").alias("both_buyers"))
        .where(F.col("both_buyers") >= found.min_count)
    )
    a = found.items.select(F.col("item").alias("item_a"), F.col("item_count").alias("buyers_a"))
    b = found.items.select(F.col("item").alias("item_b"), F.col("item_count").alias("buyers_b"))
    everyone = F.lit(found.baskets)
    return together.join(a, "item_a").join(b, "item_b").select(
        "item_a", "item_b", "buyers_a", "buyers_b", "both_buyers",
        ratio(F.col("both_buyers"), everyone).alias("support"),
        ratio(F.col("both_buyers"), F.col("buyers_a")).alias("confidence"),
        (ratio(F.col("both_buyers"), F.col("buyers_a")) / ratio(F.col("buyers_b"), everyone))
        .alias("lift"),
    )
