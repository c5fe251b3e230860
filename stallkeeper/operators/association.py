"""Pair rules between products, or categories, that are bought together."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallkeeper.functions import materialize, ratio, scalar
from stallkeeper.operators.category import category_items, product_categories
from stallkeeper.operators.metrics import delivered_orders
from stallkeeper.sources.model import Commerce


BLOCK = 256  # items of a basket in one block, about


def pair_counts(baskets: DataFrame, min_count: int, block: int = BLOCK) -> DataFrame:
    """Exact number of orders per item pair, for pairs in at least ``min_count`` orders.

    ``baskets`` holds distinct (order_id, item). Items in fewer orders than asked for cannot be part of a
    frequent pair and are dropped first. A basket's items fall into blocks by hash, one block for an ordinary
    basket; every pair of blocks meets as a key of its own, so the pairs of a giant basket are spread over
    tasks, and they are counted map-side.
    """
    per_item = baskets.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    kept = baskets.join(per_item.select("item"), "item", "left_semi")
    blocks = kept.groupBy("order_id").agg(F.count("*").alias("size")).where("size > 1").select(
        "order_id", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (kept.join(blocks, "order_id").withColumn("own", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
             .withColumn("other", other))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    left = dealt.where("own <= other").select("order_id", low.alias("low"), high.alias("high"), F.col("item").alias("x"))
    right = dealt.where("own >= other").select("order_id", low.alias("low"), high.alias("high"), F.col("item").alias("y"))
    met = left.join(right, ["order_id", "low", "high"]).where("low < high OR x < y")
    return (met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def rules(baskets: DataFrame, total_orders, min_count: int, min_confidence: float, min_lift: float) -> DataFrame:
    """Both directions of every frequent pair that pass the confidence and lift thresholds."""
    support = baskets.groupBy("item").agg(F.count("*").alias("orders"))
    pairs = pair_counts(baskets, min_count)
    way = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ways = F.array(way("a", "b"), way("b", "a"))
    both = pairs.select("n", F.explode(ways).alias("w")).select(
        "n", F.col("w.x").alias("item_a"), F.col("w.y").alias("item_b"))
    j = (both.join(support.select(F.col("item").alias("item_a"), F.col("orders").alias("ca")), "item_a")
         .join(support.select(F.col("item").alias("item_b"), F.col("orders").alias("cb")), "item_b")
         .withColumn("t", total_orders))
    confidence = ratio("n", "ca")
    return j.select(
        "item_a", "item_b", F.col("ca").alias("antecedent_orders"), F.col("cb").alias("consequent_orders"),
        F.col("n").alias("cooccurrence_orders"), ratio("n", "t").alias("support"), confidence.alias("confidence"),
        (confidence / ratio("cb", "t")).alias("lift")).where(
        (F.col("confidence") >= min_confidence) & (F.col("lift") > min_lift))


def _top(df: DataFrame, n: int) -> DataFrame:
    from pyspark.sql import Window as W
    order = [F.desc("lift"), F.desc("cooccurrence_orders"), F.desc("confidence"), "item_a", "item_b"]
    best = df.orderBy(*order).limit(n)
    return best.withColumn("rule_rank", F.row_number().over(W.partitionBy().orderBy(*order)).cast("bigint"))


def _total(m: Commerce):
    return scalar(delivered_orders(m).agg(F.count("*").alias("n")), "n")["n"]


def association_product(m: Commerce, min_count: int = 5, min_confidence: float = 0.1, min_lift: float = 1.0,
                        n: int = 20) -> DataFrame:
    baskets = materialize(category_items(m).select("order_id", F.col("product_id").alias("item")).distinct())
    top = _top(rules(baskets, _total(m), min_count, min_confidence, min_lift), n)
    cats = product_categories(m)
    name = lambda side: cats.select(F.col("product_id").alias(f"item_{side}"),
                                    F.col("category_name").alias(f"category_{side}"))
    return (top.join(name("a"), "item_a").join(name("b"), "item_b")
            .withColumnRenamed("item_a", "product_a").withColumnRenamed("item_b", "product_b"))


def association_category(m: Commerce, min_count: int = 5, min_confidence: float = 0.1, min_lift: float = 1.0,
                         n: int = 20) -> DataFrame:
    baskets = materialize(category_items(m).select("order_id", F.col("category_name").alias("item")).distinct())
    return (_top(rules(baskets, _total(m), min_count, min_confidence, min_lift), n)
            .withColumnRenamed("item_a", "category_a").withColumnRenamed("item_b", "category_b"))
