"""Regions clustered into market tiers by size, growth, competition and logistics cost."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from stallkeeper.functions import count_if, dbl, half_up, materialize, ratio
from stallkeeper.functions.fitting import GRID, k_means, nearest_centre, scale
from stallkeeper.operators.cleaning import sellable_items
from stallkeeper.operators.customers import market_growth_base
from stallkeeper.operators.metrics import delivered
from stallkeeper.sources.model import Commerce

FEATURES = ["log_recent_gmv", "gmv_growth_rate", "seller_concentration", "freight_share"]


def region_features(m: Commerce, months: int = 6) -> DataFrame:
    """One row per state: recent revenue (also as a logarithm), its growth against the window before, concentration of
    its sellers (sum of squared shares of item value: 1 means a single seller) and freight per item value.

    Items are summed per state and seller before anything is divided, so a state with most of all items is merged
    map-side."""
    orders = m.orders_core.where(delivered() & F.col("order_purchase_timestamp").isNotNull()
                                 & F.col("order_estimated_delivery_date").isNotNull())
    placed = orders.join(m.customers.select("customer_id", "customer_state"), "customer_id").select("order_id", "customer_state")
    by_seller = (sellable_items(m).join(placed, "order_id").groupBy("customer_state", "seller_id")
                 .agg(F.sum("price").alias("price"), F.sum("freight_value").alias("freight")))
    supply = by_seller.groupBy("customer_state").agg(
        F.count("*").alias("seller_count"), F.sum("price").alias("item_value"), F.sum("freight").alias("freight"),
        F.sum(dbl("price") * dbl("price")).alias("_squares"))
    market = market_growth_base(m, months).select("customer_state", "recent_gmv", "recent_unique_users", "gmv_growth_rate")
    return market.join(supply, "customer_state", "left").select(
        "customer_state", "recent_gmv", "recent_unique_users", F.coalesce("seller_count", F.lit(0)).alias("seller_count"),
        F.ln(F.lit(1.0) + F.col("recent_gmv")).alias("log_recent_gmv"), "gmv_growth_rate",
        ratio("_squares", dbl("item_value") * dbl("item_value")).alias("seller_concentration"),
        ratio("freight", "item_value").alias("freight_share"))


def region_tiers(m: Commerce, tiers: int = 4, months: int = 6, rounds: int = 15) -> DataFrame:
    """States by k-means tier (1: the centre with the most revenue) and place in the order of expansion: tier, then
    growth. A state that lacks a feature (no prior revenue, no items) has no tier and comes last."""
    states = materialize(region_features(m, months))
    whole = states.dropna(subset=FEATURES)
    scores = scale(whole, [F.col(f) for f in FEATURES]).scores([F.col(f) for f in FEATURES])
    names = [f"z{i}" for i in range(len(FEATURES))]
    points = materialize(whole.select("customer_state", *[
        F.round(s * GRID).cast("bigint").alias(n) for s, n in zip(scores, names)]))
    centres = sorted(k_means(points, "customer_state", names, tiers, rounds), reverse=True)
    if centres:
        near = nearest_centre(names, centres)
        placed = points.select("customer_state", (near["i"] + 1).cast("bigint").alias("tier"),
                               (F.sqrt(near["d"]) / GRID).alias("centre_distance"))
    else:
        placed = points.select("customer_state", F.lit(None).cast("bigint").alias("tier"),
                               F.lit(None).cast("double").alias("centre_distance"))
    order = W.partitionBy().orderBy(F.col("tier").asc_nulls_last(), F.col("gmv_growth_rate").desc_nulls_last(),
                                    "customer_state")  # one row per state
    return states.join(placed, "customer_state", "left").select(
        "customer_state", "tier", F.row_number().over(order).cast("bigint").alias("expansion_rank"), "recent_gmv",
        "recent_unique_users", "seller_count", *[half_up(f, 6).alias(f) for f in FEATURES[1:]],
        half_up("centre_distance", 6).alias("centre_distance"))


def region_tier_summary(m: Commerce, tiers: int = 4, months: int = 6, rounds: int = 15) -> DataFrame:
    """What the tiers are like, and their share of revenue."""
    t = region_tiers(m, tiers, months, rounds).where("tier IS NOT NULL")
    total = F.sum("gmv").over(W.partitionBy())
    return t.groupBy("tier").agg(
        F.count("*").alias("state_count"), F.sum(F.col("recent_gmv").cast("decimal(28,2)")).alias("gmv"),
        F.sum("recent_unique_users").alias("user_count"),
        *[half_up(F.avg(f), 4).alias(f"average_{f}") for f in FEATURES[1:]],
        count_if(F.col("gmv_growth_rate") > 0).alias("growing_state_count")).select(
        "tier", "state_count", dbl("gmv").alias("recent_gmv"), half_up(ratio("gmv", total), 6).alias("gmv_share"), "user_count",
        *[f"average_{f}" for f in FEATURES[1:]], "growing_state_count")
