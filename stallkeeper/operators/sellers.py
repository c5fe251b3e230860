"""Seller scorecard: sales, dispatch and service, with small sellers' rates drawn towards the market's."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper.functions import count_if, counted_ranks, dbl, flag, half_up, materialize, ratio, scalar
from stallkeeper.operators.cleaning import latest_review, sellable_items, valid_reviews
from stallkeeper.operators.metrics import delivered
from stallkeeper.sources.model import Commerce

WEIGHTS = {"sales": 0.4, "dispatch": 0.3, "service": 0.3}
GRADES = (("A", 75), ("B", 50), ("C", 25))  # lowest score of a grade; below all: D


def seller_facts(m: Commerce) -> DataFrame:
    """Per seller with a delivered order: orders, items, revenue, shipments handed over by the shipping limit among
    those with both dates, and orders with a positive review among those reviewed. Items collapse to one row per order
    and seller first."""
    sent = sellable_items(m).groupBy("order_id", "seller_id").agg(
        F.count("*").alias("items"), F.sum("price").alias("price"), F.max("shipping_limit_date").alias("limit"))
    review = latest_review(valid_reviews(m)).select("order_id", "review_score")
    orders = m.orders.where(delivered()).select("order_id", F.col("order_delivered_carrier_date").alias("handed"))
    rows = sent.join(orders, "order_id").join(review, "order_id", "left")
    judged = F.col("handed").isNotNull() & F.col("limit").isNotNull()
    return rows.groupBy("seller_id").agg(
        F.count("*").alias("order_count"), F.sum("items").alias("item_count"), F.sum("price").alias("gmv"),
        count_if(judged).alias("dispatch_n"), count_if(judged & (F.col("handed") <= F.col("limit"))).alias("dispatch_x"),
        F.count("review_score").alias("service_n"), count_if(F.col("review_score") >= 4).alias("service_x"))


def prior(n: str, x: str) -> list[Column]:
    """Moments of a rate x / n over many units, as aggregates: mean, and strength in observations.

    The variance between units is what their rates scatter beyond chance: (sum n (r - p)^2 - (units - 1) p (1 - p)) /
    (N - sum n^2 / N). Strength is p (1 - p) / variance - 1; NULL where units differ no more than by chance."""
    total, hits = dbl(F.sum(n)), dbl(F.sum(x))
    p = F.try_divide(hits, total)
    scatter = F.sum(F.try_divide(dbl(x) * dbl(x), dbl(n))) - total * p * p
    units = dbl(count_if(F.col(n) > 0))
    between = F.try_divide(scatter - (units - 1) * p * (1 - p), total - F.try_divide(F.sum(dbl(n) * dbl(n)), total))
    return [p.alias(f"{n}_mean"), F.when(between > 0, F.greatest(F.lit(0.0), p * (1 - p) / between - 1)).alias(f"{n}_strength")]


def shrunk(n: str, x: str, prior_row: Column) -> Column:
    """(x + strength * mean) / (n + strength); the mean itself where units do not differ."""
    mean, strength = prior_row[f"{n}_mean"], prior_row[f"{n}_strength"]
    return F.coalesce(F.try_divide(F.col(x) + strength * mean, F.col(n) + strength), mean)


def seller_scorecard(m: Commerce, weights: dict[str, float] = WEIGHTS, grades: Sequence[tuple[str, float]] = GRADES) -> DataFrame:
    """Three scores from 0 to 100 per seller (place among all sellers by revenue, shrunk dispatch rate and shrunk rate of
    positive reviews; equal sellers share the mean place), their weighted sum, and a grade."""
    facts = materialize(seller_facts(m))
    priors = facts.agg(*prior("dispatch_n", "dispatch_x"), *prior("service_n", "service_x"))
    row = scalar(priors, *priors.columns)
    rows = facts.withColumn("_prior", row)
    rows = materialize(rows.select(
        *facts.columns, dbl("gmv").alias("sales_value"),
        F.round(shrunk("dispatch_n", "dispatch_x", F.col("_prior")), 9).alias("dispatch_value"),
        F.round(shrunk("service_n", "service_x", F.col("_prior")), 9).alias("service_value")))
    total = scalar(rows.agg(F.count("*").alias("n")), "n")["n"]
    scored = rows
    for d in weights:
        # A market without any judged shipment or review has no rate to rank; all its sellers stand in the middle.
        ranks = counted_ranks(rows, f"{d}_value").select(f"{d}_value", ((F.col("average_rank") - 1)).alias(f"_{d}"))
        scored = scored.join(ranks, f"{d}_value", "left")
    place = lambda d: F.coalesce(F.try_divide(100 * F.col(f"_{d}"), F.col("_n") - 1), F.lit(50.0))
    score = sum((place(d) * F.lit(w) for d, w in weights.items()), F.lit(0.0))
    scored = scored.withColumn("_n", dbl(total)).withColumn("_score", F.round(score, 6))
    grade = F.lit("D")
    for name, least in reversed(grades):
        grade = F.when(F.col("_score") >= least, name).otherwise(grade)
    return scored.select(
        "seller_id", "order_count", "item_count", dbl("gmv").alias("gmv"),
        half_up(ratio("dispatch_x", "dispatch_n"), 6).alias("on_time_rate"), half_up("dispatch_value", 6).alias("shrunk_on_time_rate"),
        half_up(ratio("service_x", "service_n"), 6).alias("positive_rate"), half_up("service_value", 6).alias("shrunk_positive_rate"),
        *[half_up(place(d), 4).alias(f"{d}_score") for d in weights], half_up("_score", 4).alias("score"), grade.alias("grade"))


def seller_grade_summary(m: Commerce) -> DataFrame:
    """Sellers, revenue and rates by grade."""
    facts = seller_scorecard(m)
    total = scalar(facts.agg(F.sum(F.col("gmv").cast("decimal(28,2)")).alias("g")), "g")["g"]
    out = facts.groupBy("grade").agg(
        F.count("*").alias("seller_count"), F.sum("order_count").alias("order_count"),
        F.sum(F.col("gmv").cast("decimal(28,2)")).alias("gmv"), half_up(F.avg("score"), 4).alias("average_score"),
        half_up(F.avg("shrunk_on_time_rate"), 4).alias("average_on_time_rate"),
        half_up(F.avg("shrunk_positive_rate"), 4).alias("average_positive_rate"), F.sum(flag(F.col("order_count") < 5)).alias("small_seller_count"))
    return out.select("grade", "seller_count", "order_count", dbl("gmv").alias("gmv"), half_up(ratio("gmv", total), 6).alias("gmv_share"),
                      "average_score", "average_on_time_rate", "average_positive_rate", "small_seller_count")
