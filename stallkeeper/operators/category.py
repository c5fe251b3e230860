"""Product categories: sales layers, Pareto, growth, classes, satisfaction and display tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from stallkeeper.functions import count_if, dbl, half_up, materialize, month_index, month_of, ratio, scalar
from stallkeeper.operators import cleaning as C
from stallkeeper.operators.checks import register
from stallkeeper.operators.metrics import delivered_orders
from stallkeeper.sources.model import Commerce

UNKNOWN = "unknown"


def product_categories(m: Commerce) -> DataFrame:
    """English category per product; missing, blank and untranslated names become unknown."""
    names = m.translation.select("product_category_name", "product_category_name_english")
    english = F.trim("product_category_name_english")
    return (m.products.select("product_id", "product_category_name").join(names, "product_category_name", "left")
            .select("product_id", F.when(english != "", english).otherwise(UNKNOWN).alias("category_name")))


def category_items(m: Commerce) -> DataFrame:
    """Delivered items with category and purchase month; money stays decimal."""
    orders = delivered_orders(m).select("order_id", F.col("order_purchase_timestamp").alias("purchase_timestamp"))
    return (C.sellable_items(m).select("order_id", "order_item_id", "product_id", "price", "freight_value")
            .join(orders, "order_id").join(product_categories(m), "product_id")
            .select("order_id", "order_item_id", "product_id", "category_name", "purchase_timestamp",
                    month_of("purchase_timestamp").alias("purchase_month"), "price", "freight_value"))


def category_item_base(m: Commerce) -> DataFrame:
    return category_items(m).withColumn("price", dbl("price")).withColumn("freight_value", dbl("freight_value"))


def category_orders(m: Commerce) -> DataFrame:
    return category_items(m).groupBy("order_id", "category_name", "purchase_month").agg(
        F.count("*").alias("category_item_count"), F.sum("price").alias("category_sales_amount"))


def category_order_base(m: Commerce) -> DataFrame:
    return category_orders(m).withColumn("category_sales_amount", dbl("category_sales_amount"))


def _sales(m: Commerce, monthly: DataFrame | None = None) -> DataFrame:
    """One row per category at full precision with the grand total; later windows over it are
    bounded by the number of categories. ``monthly`` may bring the months by category already summed:
    an order has one month, so its counts add up."""
    t = (_monthly(m) if monthly is None else monthly).groupBy("category_name").agg(
        F.sum("sales").alias("sales"), F.sum("monthly_order_count").alias("category_order_count"),
        F.sum("monthly_item_count").alias("item_count"))
    a = W.partitionBy()
    return t.withColumn("total", F.sum("sales").over(a)).withColumn(
        "sales_rank", F.row_number().over(a.orderBy(F.desc("sales"), "category_name")).cast("bigint"))


def category_sales(m: Commerce, monthly: DataFrame | None = None) -> DataFrame:
    return _sales(m, monthly).select(
        "category_name", dbl("sales").alias("sales_amount"), ratio("sales", "total").alias("sales_share"),
        "category_order_count", "item_count", ratio("sales", "item_count").alias("avg_item_price"),
        ratio("item_count", "category_order_count").alias("items_per_order"), "sales_rank")


def _monthly(m: Commerce) -> DataFrame:
    return category_orders(m).groupBy("purchase_month", "category_name").agg(
        F.sum("category_sales_amount").alias("sales"), F.count("*").alias("monthly_order_count"),
        F.sum("category_item_count").alias("monthly_item_count"))


def category_monthly_sales(m: Commerce, monthly: DataFrame | None = None) -> DataFrame:
    return (_monthly(m) if monthly is None else monthly).select(
        "purchase_month", "category_name", dbl("sales").alias("monthly_sales_amount"), "monthly_order_count",
        "monthly_item_count", ratio("sales", "monthly_item_count").alias("avg_item_price"),
        ratio("monthly_item_count", "monthly_order_count").alias("items_per_order"))


def category_pareto(m: Commerce, head_share: float = 0.8) -> DataFrame:
    """Cumulative sales; the category that crosses the head share still belongs to the head."""
    run = W.partitionBy().orderBy("sales_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = _sales(m).withColumn("cum", F.sum("sales").over(run))
    before = F.col("cum") - F.col("sales")
    return s.select(
        "category_name", dbl("sales").alias("sales_amount"), ratio("sales", "total").alias("sales_share"),
        dbl("cum").alias("cumulative_sales_amount"), ratio("cum", "total").alias("cumulative_sales_share"), "sales_rank",
        F.when(before < F.col("total") * F.lit(str(head_share)).cast("decimal(4,2)"), "head")
        .otherwise("long_tail").alias("category_type"))


# ------------------------------------------------------------ growth

def category_mom(m: Commerce, first_month: str, last_month: str) -> DataFrame:
    """Change against the calendar month before; NULL when that month has no sales."""
    w = W.partitionBy("category_name").orderBy("purchase_month")
    rows = _monthly(m).withColumn("i", month_index("purchase_month")).withColumn(
        "next_to", F.col("i") - F.lag("i").over(w) == 1)
    change = lambda c: F.when(F.col("next_to"), ratio(dbl(c) - dbl(F.lag(c).over(w)), F.lag(c).over(w)))
    return rows.select(
        "purchase_month", "category_name", dbl("sales").alias("monthly_sales_amount"),
        change("sales").alias("sales_mom_growth"), "monthly_order_count",
        change("monthly_order_count").alias("order_mom_growth"), "monthly_item_count",
        change("monthly_item_count").alias("item_mom_growth")).where(
        F.col("purchase_month").between(first_month, last_month))


def category_cmgr(m: Commerce, first_month: str, last_month: str, monthly: DataFrame | None = None) -> DataFrame:
    """Compound monthly growth per category (only where both end months have sales) and of the
    whole platform. Start and end come from one aggregate over the months."""
    base = (_monthly(m) if monthly is None else monthly).where(
        F.col("purchase_month").between(first_month, last_month)).select("category_name", "purchase_month", "sales")
    whole = base.groupBy("purchase_month").agg(F.sum("sales").cast("decimal(38,2)").alias("sales")).select(
        F.lit("platform").alias("level"), F.lit("ALL").alias("category_name"), "purchase_month", "sales")
    both = base.select(F.lit("category").alias("level"), "category_name", "purchase_month",
                       F.col("sales").cast("decimal(38,2)").alias("sales")).unionByName(whole)
    ends = both.groupBy("level", "category_name").agg(
        F.min("purchase_month").alias("start_month"), F.max("purchase_month").alias("end_month"),
        dbl(F.min_by("sales", "purchase_month")).alias("start_sales"),
        dbl(F.max_by("sales", "purchase_month")).alias("end_sales"))
    diff = month_index("end_month") - month_index("start_month")
    usable = (F.col("start_sales") > 0) & (diff > 0) & (
        (F.col("level") == "platform") | ((F.col("start_month") == first_month) & (F.col("end_month") == last_month)))
    growth = F.pow(F.col("end_sales") / F.col("start_sales"), 1.0 / diff) - 1
    return ends.select("*", diff.alias("month_diff"), half_up(F.when(usable, growth), 9).alias("category_cmgr"))


def category_class(m: Commerce, first_month: str, last_month: str, margin: float = 0.05) -> DataFrame:
    """Star, potential, stable, declining or emerging, by growth against the platform and sales
    against the median category."""
    monthly = materialize(_monthly(m))  # months by categories, all that follows needs
    g = category_cmgr(m, first_month, last_month, monthly)
    platform = scalar(g.where("level = 'platform'").select("category_cmgr"), "category_cmgr")["category_cmgr"]
    c = (g.where("level = 'category'").join(category_sales(m, monthly).select("category_name", "sales_amount"), "category_name", "left")
         .withColumn("platform_cmgr", platform))
    a = W.partitionBy()  # one row per category
    # The median is over all categories, also those outside the growth window.
    median = scalar(category_sales(m, monthly).agg(F.percentile("sales_amount", F.lit(0.5)).alias("m")), "m")["m"]
    v, fast = F.col("category_cmgr"), F.col("category_cmgr") > F.col("platform_cmgr") + margin
    big = F.col("sales_amount") > F.col("median")
    # Class names.
    kind = (F.when(fast & big, "Star Category").when(fast, "Potential Category").when(v >= 0, "Stable Category")
            .when(v < 0, "Declining Category")
            .when((F.col("start_month") > first_month) & (F.col("end_month") == last_month), "Emerging Category")
            .when(F.col("end_month") < last_month, "Declining Category"))
    return c.withColumn("median", median).select(
        "category_name", "sales_amount", "category_cmgr",
        half_up(F.avg("category_cmgr").over(a), 6).alias("avg_category_cmgr"), "platform_cmgr", kind.alias("category_type"))


# ------------------------------------------------------------ satisfaction

def satisfaction(reviews: DataFrame, min_reviews: int = 30) -> DataFrame:
    """Scores per category. ``reviews`` has one row per order and category, the score NULL where
    the order has no review; such rows keep their category in the report."""
    score, text = F.col("review_score"), F.trim("review_comment_message")
    valid = count_if(score.between(1, 5))
    by = reviews.groupBy("category_name").agg(
        valid.alias("valid_review_orders"),
        ratio(F.sum(F.when(score.between(1, 5), score)), valid).alias("avg_review_score"),
        count_if(score == 1).alias("one_star_review_orders"),
        count_if(score.isin(4, 5)).alias("positive_4_5_review_orders"),
        count_if((score == 1) & (text != "")).alias("negative_text_review_orders"))
    return by.select(
        "category_name", "valid_review_orders", "avg_review_score", "one_star_review_orders",
        ratio("one_star_review_orders", "valid_review_orders").alias("one_star_rate"), "positive_4_5_review_orders",
        ratio("positive_4_5_review_orders", "valid_review_orders").alias("positive_4_5_rate"),
        "negative_text_review_orders",
        F.when(F.col("valid_review_orders") >= min_reviews, "eligible").otherwise("small_sample").alias("sample_status"))


def category_reviews(m: Commerce) -> DataFrame:
    """Order by category with the representative review of the order."""
    pairs = category_items(m).groupBy("order_id", "category_name").agg(F.lit(1).alias("one")).drop("one")
    review = C.latest_review(C.valid_reviews(m)).select("order_id", "review_score", "review_comment_message")
    return pairs.join(review, "order_id", "left")


def category_satisfaction(m: Commerce, min_reviews: int = 30) -> DataFrame:
    return satisfaction(category_reviews(m), min_reviews)


def keyword_candidates(m: Commerce, n: int = 15, min_reviews: int = 30) -> DataFrame:
    """Eligible categories with most one-star reviews that carry text."""
    return (category_satisfaction(m, min_reviews)
            .where((F.col("sample_status") == "eligible") & (F.col("negative_text_review_orders") > 0))
            .select("category_name", "one_star_rate", "negative_text_review_orders")
            .orderBy(F.desc("one_star_rate"), F.desc("negative_text_review_orders"), "category_name").limit(n))


def complaint_top12(m: Commerce, n: int = 12, min_reviews: int = 30) -> DataFrame:
    return (category_satisfaction(m, min_reviews).where("sample_status = 'eligible'")
            .select("category_name", "avg_review_score", "one_star_rate", "valid_review_orders")
            .orderBy("avg_review_score", F.desc("one_star_rate"), F.desc("valid_review_orders"), "category_name").limit(n))


def months_between(first: str, last: str) -> list[str]:
    y, k = map(int, first.split("-"))
    out = []
    while (name := f"{y:04d}-{k:02d}") <= last:
        out.append(name)
        y, k = (y + 1, 1) if k == 12 else (y, k + 1)
    return out


def category_heatmap_topn(m: Commerce, first_month: str, last_month: str, n: int = 15) -> DataFrame:
    """Monthly sales of the n largest categories of the window, one column per month."""
    months = months_between(first_month, last_month)
    wide = (_monthly(m).where(F.col("purchase_month").between(first_month, last_month))
            .groupBy("category_name").pivot("purchase_month", months).agg(F.sum("sales")))
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in months])
    return (wide.withColumn("total_sales", total).orderBy(F.desc("total_sales"), "category_name").limit(n)
            .select("category_name", *[dbl(F.col(f"`{c}`")).alias(c) for c in months], dbl("total_sales").alias("total_sales")))


# ------------------------------------------------------------ audit

# Check, fact, expected fact or number, tolerance.
LAYER_CHECKS = [
    ("one row per order and category", "duplicate_order_categories", 0, 0),
    ("one row per category", "duplicate_categories", 0, 0), ("no blank category", "blank_categories", 0, 0),
    ("category metrics are valid", "invalid_category_metrics", 0, 0),
    ("sales ranks follow sales", "sales_rank_mismatches", 0, 0),
    ("one row per month and category", "duplicate_month_categories", 0, 0),
    ("monthly metrics are valid", "invalid_monthly_metrics", 0, 0),
    ("order counts of categories", "order_count_mismatches", 0, 0),
    ("order counts of months", "monthly_order_count_mismatches", 0, 0),
    ("item counts of months", "monthly_item_count_mismatches", 0, 0),
    ("only delivered orders", "non_delivered_orders", 0, 0),
    ("purchase times are those of the orders", "purchase_timestamp_mismatches", 0, 0),
    ("sales of categories equal sales of items", "category_sales_amount", "item_base_sales_amount", 0.01),
    ("sales of months equal sales of items", "monthly_sales_amount", "item_base_sales_amount", 0.01),
    ("items of categories equal items", "category_item_count", "item_base_rows", 0),
    ("items of months equal items", "monthly_item_count", "item_base_rows", 0),
    ("orders of categories equal order-category rows", "category_order_count", "order_category_rows", 0),
    ("orders of months equal order-category rows", "monthly_order_count", "order_category_rows", 0),
    ("sales shares add up to 1", "sales_share_sum", 1, 1e-9),
    ("unknown items are kept", "unknown_item_rows", "unknown_items_of_months", 0),
    ("unknown category is kept", "unknown_category_rows", "has_unknown_items", 0),
    ("boundary months are kept", "boundary_month_items", "boundary_item_rows", 0),
]


def category_layer_audit(m: Commerce, boundary_months: list[str]) -> DataFrame:
    """Grain, reconciliation and unknown-category checks of the category layers, each against what it must be.
    The order-category layer is stored once; every layer is reduced to one row of numbers."""
    items, pairs = category_items(m), materialize(category_orders(m))
    months = materialize(_monthly(m))
    monthly, sales = category_monthly_sales(m, months), category_sales(m, months)
    unknown, boundary = F.col("category_name") == UNKNOWN, F.col("purchase_month").isin(*boundary_months)
    zero = lambda c: F.coalesce(c, F.lit(0))
    odd = lambda cols: reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    differ = lambda a, b: count_if(~F.coalesce(F.col(a) == F.col(b), F.lit(False)))
    by_sales = W.partitionBy().orderBy(F.desc("sales_amount"), "category_name")
    counted = pairs.groupBy("purchase_month", "category_name").agg(
        F.count("*").alias("e_orders"), F.sum("category_item_count").alias("e_items"))
    parts = [
        (items, {"item_base_rows": F.count("*"), "item_base_sales_amount": F.sum("price"),
                 "unknown_item_rows": count_if(unknown), "has_unknown_items": F.max(unknown.cast("int")),
                 "boundary_item_rows": count_if(boundary)}),
        (pairs.groupBy("order_id", "category_name").agg(F.count("*").alias("n")),
         {"order_category_rows": zero(F.sum("n")), "duplicate_order_categories": count_if(F.col("n") > 1)}),
        (sales.withColumn("_rank", F.row_number().over(by_sales)),
         {"category_sales_amount": F.sum(F.col("sales_amount").cast("decimal(28,2)")),
          "category_item_count": F.sum("item_count"), "category_order_count": F.sum("category_order_count"),
          "sales_share_sum": half_up(F.sum("sales_share"), 9), "unknown_category_rows": count_if(unknown),
          "duplicate_categories": F.count("*") - F.countDistinct("category_name"),
          "blank_categories": count_if(F.trim("category_name") == ""), "sales_rank_mismatches": differ("_rank", "sales_rank"),
          "invalid_category_metrics": count_if(odd(sales.columns) | (F.col("item_count") <= 0))}),
        (monthly, {"monthly_sales_amount": F.sum(F.col("monthly_sales_amount").cast("decimal(28,2)")),
                   "monthly_item_count": F.sum("monthly_item_count"), "monthly_order_count": F.sum("monthly_order_count"),
                   "unknown_items_of_months": zero(F.sum(F.when(unknown, F.col("monthly_item_count")))),
                   "boundary_month_items": zero(F.sum(F.when(boundary, F.col("monthly_item_count")))),
                   "duplicate_month_categories": F.count("*") - F.countDistinct("purchase_month", "category_name"),
                   "invalid_monthly_metrics": count_if(odd(monthly.columns)
                                                       | ~F.col("purchase_month").rlike("^[0-9]{4}-[0-9]{2}$"))}),
        (counted.join(monthly, ["purchase_month", "category_name"], "outer"),
         {"monthly_order_count_mismatches": differ("e_orders", "monthly_order_count"),
          "monthly_item_count_mismatches": differ("e_items", "monthly_item_count")}),
        (pairs.groupBy("category_name").agg(F.count("*").alias("e")).join(sales, "category_name", "outer"),
         {"order_count_mismatches": differ("e", "category_order_count")}),
        (items.select("order_id", "purchase_timestamp").distinct().join(
            m.orders_core.select("order_id", "order_status", "order_purchase_timestamp"), "order_id"),
         {"non_delivered_orders": count_if(F.col("order_status") != "delivered"),
          "purchase_timestamp_mismatches": count_if(F.col("purchase_timestamp") != F.col("order_purchase_timestamp"))}),
    ]
    return register(parts, LAYER_CHECKS)
