"""Cleaned views. Rows that cannot be used are dropped; long tails are only flagged."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallkeeper.functions import (MICROS_PER_DAY, dbl, fences, flag, micros_between, outside, scalar,
                                   top_row_per_key)
from stallkeeper.sources.model import Commerce


def chronology_error():
    """Some later step is dated before an earlier one (missing steps cannot conflict)."""
    bought, approved, carrier, delivered = (
        F.col("order_purchase_timestamp"), F.col("order_approved_at"),
        F.col("order_delivered_carrier_date"), F.col("order_delivered_customer_date"))
    checks = [approved < bought, carrier < approved, delivered < carrier, delivered < bought]
    out = F.lit(False)
    for c in checks:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _usable_orders(m: Commerce, orders: DataFrame) -> DataFrame:
    return (orders.where(F.col("order_id").isNotNull() & F.col("customer_id").isNotNull()
                         & F.col("order_purchase_timestamp").isNotNull()
                         & F.col("order_estimated_delivery_date").isNotNull())
            .join(m.customers.select("customer_id"), "customer_id", "left_semi"))


def clean_orders(m: Commerce) -> DataFrame:
    """Orders with valid keys, times and customer, plus missing-step and chronology flags."""
    return _usable_orders(m, m.orders).select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
        "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
        flag(F.col("order_approved_at").isNull()).alias("is_missing_approval_timestamp"),
        flag(F.col("order_delivered_carrier_date").isNull()).alias("is_missing_carrier_timestamp"),
        flag(F.col("order_delivered_customer_date").isNull()).alias("is_missing_delivery_timestamp"),
        flag(chronology_error()).alias("has_chronology_error"))


def clean_orders_core(m: Commerce) -> DataFrame:
    """The same rows as ``clean_orders`` without the delivery columns (one shuffle less)."""
    return _usable_orders(m, m.orders_core)


def delivery_times(orders: DataFrame) -> DataFrame:
    """Orders delivered no earlier than bought, with the exact span."""
    span = micros_between("order_delivered_customer_date", "order_purchase_timestamp")
    return (orders.where(F.col("order_delivered_customer_date") >= F.col("order_purchase_timestamp"))
            .withColumn("delivery_micros", span)
            .withColumn("delivery_days", F.col("delivery_micros") / F.lit(MICROS_PER_DAY)))


def clean_delivery(m: Commerce) -> DataFrame:
    """Orders with a computable delivery span and its IQR flag."""
    rows = delivery_times(clean_orders(m))
    bounds = scalar(fences(rows.select("delivery_days"), "delivery_days"), "lower_bound", "upper_bound")
    return rows.select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
        "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
        "delivery_days",
        F.col("has_chronology_error").alias("has_intermediate_chronology_error"),
        outside("delivery_days", bounds).alias("is_delivery_iqr_extreme"))


def positive_payments(m: Commerce) -> DataFrame:
    """Payment rows that count as revenue. Callers that go on to join orders need no
    separate existence check."""
    return m.payments.where(
        F.col("order_id").isNotNull() & F.col("payment_sequential").isNotNull()
        & (F.col("payment_value") > 0) & (F.col("payment_installments") >= 0))


def clean_payments(m: Commerce) -> DataFrame:
    """Positive payments of known orders. The fences come from every non-null value,
    before any row is dropped."""
    bounds = scalar(fences(m.payments, "payment_value"), "lower_bound", "upper_bound")
    return (positive_payments(m).join(m.orders_core.select("order_id"), "order_id", "left_semi")
            .select("order_id", "payment_sequential", "payment_type", "payment_installments",
                    dbl("payment_value").alias("payment_value"),
                    flag(F.col("payment_installments") == 0).alias("needs_installment_review"),
                    outside("payment_value", bounds).alias("is_payment_value_iqr_extreme")))


def sellable_items(m: Commerce) -> DataFrame:
    """Item rows with usable amounts; callers that join orders and products need only
    the seller check on top."""
    return m.items.where(
        F.col("order_id").isNotNull() & F.col("order_item_id").isNotNull()
        & F.col("product_id").isNotNull() & F.col("seller_id").isNotNull()
        & (F.col("price") >= 0) & (F.col("freight_value") >= 0)
    ).join(m.sellers.select("seller_id"), "seller_id", "left_semi")


def clean_items(m: Commerce) -> DataFrame:
    """Items of known orders, products and sellers, with price and freight flags. Both fences
    come from one scan of the amounts."""
    names = ("price", "freight_value")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), dbl(c).alias("v")) for c in names])
    both = fences(m.items.select(F.explode(cells).alias("c")).select("c.field", "c.v"), "v", ["field"])
    at = lambda c, b: F.max(F.when(F.col("field") == c, F.col(b)))
    bounds = scalar(both.agg(*[at(c, b).alias(f"{c}_{b}") for c in names for b in ("lower_bound", "upper_bound")]),
                    *[f"{c}_{b}" for c in names for b in ("lower_bound", "upper_bound")])
    extreme = lambda c: flag((dbl(c) < bounds[f"{c}_lower_bound"]) | (dbl(c) > bounds[f"{c}_upper_bound"]))
    return (sellable_items(m)
            .join(m.products.select("product_id"), "product_id", "left_semi")
            .join(m.orders_core.select("order_id"), "order_id", "left_semi")
            .select("order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date",
                    dbl("price").alias("price"), dbl("freight_value").alias("freight_value"),
                    extreme("price").alias("is_price_iqr_extreme"),
                    extreme("freight_value").alias("is_freight_iqr_extreme"),
                    flag(F.col("freight_value") == 0).alias("needs_zero_freight_review")))


def dedup_geolocation(m: Commerce) -> DataFrame:
    return m.geolocation.distinct()


def valid_reviews(m: Commerce) -> DataFrame:
    return m.reviews.where(
        F.col("review_id").isNotNull() & F.col("order_id").isNotNull()
        & F.col("review_score").between(1, 5)
        & F.col("review_creation_date").isNotNull() & F.col("review_answer_timestamp").isNotNull())


def clean_reviews(m: Commerce) -> DataFrame:
    return valid_reviews(m).join(m.orders_core.select("order_id"), "order_id", "left_semi").select(
        "review_id", "order_id", "review_score", "review_comment_title", "review_comment_message",
        "review_creation_date", "review_answer_timestamp")


def latest_review(reviews: DataFrame) -> DataFrame:
    """One review per order: latest answer, then latest creation, then greatest id."""
    return top_row_per_key(reviews, ["order_id"], [
        F.col("review_answer_timestamp").desc(), F.col("review_creation_date").desc(),
        F.col("review_id").desc(), F.col("review_score").desc()])


def representative_review(m: Commerce) -> DataFrame:
    return latest_review(clean_reviews(m))
