"""The governed metrics M01 to M18 and the order-level base they share."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallkeeper.functions import (MICROS_PER_DAY, count_if, dbl, exact_mean, flag, mean_days, micros_between,
                                   month_index, month_of, ratio, scalar)
from stallkeeper.operators import cleaning as C
from stallkeeper.sources.model import Commerce



def delivered():
    return F.col("order_status") == "delivered"


def order_paid(m: Commerce) -> DataFrame:
    """Positive payments per order: always aggregated before any join."""
    return C.positive_payments(m).groupBy("order_id").agg(F.sum("payment_value").alias("amount"))


def delivered_orders(m: Commerce) -> DataFrame:
    return C.clean_orders_core(m).where(delivered())


def delivered_users(m: Commerce) -> DataFrame:
    """Delivered orders with their user. Joining the customers also proves the customer
    exists, so the semi join of the clean view is not repeated."""
    return (m.orders_core.where(delivered() & F.col("order_purchase_timestamp").isNotNull()
                                & F.col("order_estimated_delivery_date").isNotNull())
            .join(m.customers.select("customer_id", "customer_unique_id"), "customer_id")
            .where(F.col("customer_unique_id").isNotNull()))


def paid_delivered(m: Commerce) -> DataFrame:
    return delivered_orders(m).join(order_paid(m), "order_id")


def user_order_counts(m: Commerce) -> DataFrame:
    return delivered_users(m).groupBy("customer_unique_id").agg(F.count("*").alias("valid_order_count"))


def m01_gmv(m: Commerce) -> DataFrame:
    return paid_delivered(m).agg(dbl(F.sum("amount")).alias("gmv"))


def m02_valid_orders(m: Commerce) -> DataFrame:
    return delivered_orders(m).agg(F.countDistinct("order_id").alias("valid_order_count"))


def m03_aov(m: Commerce) -> DataFrame:
    return paid_delivered(m).agg(
        F.count("*").alias("paid_order_count"), dbl(F.sum("amount")).alias("paid_order_revenue"),
        ratio(F.sum("amount"), F.count("*")).alias("average_order_value"))


def m04_paid_orders(m: Commerce) -> DataFrame:
    return paid_delivered(m).agg(F.countDistinct("order_id").alias("paid_order_count"))


def m05_active_customers(m: Commerce) -> DataFrame:
    return delivered_users(m).agg(F.countDistinct("customer_unique_id").alias("active_customer_count"))


def m06_new_customers(m: Commerce) -> DataFrame:
    first = delivered_users(m).groupBy("customer_unique_id").agg(
        F.min("order_purchase_timestamp").alias("first"))
    return first.groupBy(month_of("first").alias("first_purchase_month")).agg(
        F.count("*").alias("new_customer_count"))


def m07_repeat_customers(m: Commerce) -> DataFrame:
    return user_order_counts(m).agg(count_if(F.col("valid_order_count") >= 2).alias("repeat_customer_count"))


def m08_repeat_rate(m: Commerce) -> DataFrame:
    repeat = count_if(F.col("valid_order_count") >= 2)
    return user_order_counts(m).agg(
        F.count("*").alias("active_customer_count"), repeat.alias("repeat_customer_count"),
        ratio(repeat, F.count("*")).alias("repeat_purchase_rate"))


def cohort_counts(active: DataFrame) -> DataFrame:
    """Users per cohort and activity month, with the cohort size. ``active`` has one row per
    user and month, which also bounds the window over a user by the months of the history."""
    from pyspark.sql import Window as W
    cohort = F.min("month").over(W.partitionBy("customer_unique_id"))
    seen = (active.withColumn("cohort_month", cohort).groupBy("cohort_month", "month")
            .agg(F.count("*").alias("active_users")))
    size = F.sum(F.when(F.col("month") == F.col("cohort_month"), F.col("active_users"))).over(W.partitionBy("cohort_month"))
    return seen.withColumn("initial_users", size)


def m09_retention(m: Commerce, cohort_from: str | None = None, cohort_to: str | None = None) -> DataFrame:
    """Dense cohort grid: every month from the cohort to the last observed one, zeros kept.
    Bounds keep whole cohorts by their first month and never cut their later activity."""
    active = delivered_users(m).select(
        "customer_unique_id", month_of("order_purchase_timestamp").alias("month")).distinct()
    seen = cohort_counts(active)
    last = scalar(seen.agg(F.max("month").alias("last")), "last")["last"]
    starts = seen.where(F.col("month") == F.col("cohort_month")).select("cohort_month", "initial_users")
    if cohort_from:
        starts = starts.where(F.col("cohort_month") >= cohort_from)
    if cohort_to:
        starts = starts.where(F.col("cohort_month") <= cohort_to)
    grid = (starts.withColumn("last", last)
            .withColumn("step", F.explode(F.sequence(
                F.lit(0), (month_index("last") - month_index("cohort_month")).cast("int"))))
            .withColumn("month", F.date_format(
                F.add_months(F.to_date(F.concat("cohort_month", F.lit("-01"))), F.col("step")), "yyyy-MM")))
    kept = F.coalesce(F.col("active_users"), F.lit(0))
    return grid.join(seen.drop("initial_users"), ["cohort_month", "month"], "left").select(
        "cohort_month", F.col("step").cast("bigint").alias("retention_month_number"),
        F.col("initial_users").alias("cohort_customer_count"), kept.alias("retained_customer_count"),
        ratio(kept, "initial_users").alias("customer_retention_rate"))


def user_revenue(m: Commerce) -> DataFrame:
    return (delivered_users(m).join(order_paid(m), "order_id")
            .groupBy("customer_unique_id").agg(F.sum("amount").alias("revenue")))


def m10_ltv(m: Commerce) -> DataFrame:
    return user_revenue(m).agg(
        F.count("*").alias("paying_customer_count"), dbl(F.sum("revenue")).alias("total_customer_revenue"),
        ratio(F.sum("revenue"), F.count("*")).alias("customer_lifetime_value"))


def m11_frequency(m: Commerce) -> DataFrame:
    """Counted per user first, so no wide distinct over orders is needed."""
    orders = F.sum("valid_order_count")
    return user_order_counts(m).agg(
        orders.alias("valid_order_count"), F.count("*").alias("active_customer_count"),
        ratio(orders, F.count("*")).alias("average_purchase_frequency"))


def m12_repurchase_interval(m: Commerce) -> DataFrame:
    """Average gap between neighbouring orders of a user, every gap weighing the same.

    The gaps of a user add up to last minus first purchase, so two aggregates replace
    a window over each user's orders."""
    ts = F.col("order_purchase_timestamp")
    users = delivered_users(m).groupBy("customer_unique_id").agg(
        (F.count("*") - 1).alias("gaps"), micros_between(F.max(ts), F.min(ts)).alias("span"))
    return users.where(F.col("gaps") > 0).agg(
        F.count("*").alias("repeat_customer_count"), F.sum("gaps").alias("valid_interval_count"),
        (ratio(F.sum(F.col("span").cast("decimal(20,0)")), F.sum("gaps")) / MICROS_PER_DAY)
        .alias("average_repurchase_interval_days"))


def delivered_times(m: Commerce) -> DataFrame:
    return C.delivery_times(C.clean_orders(m).where(delivered()))


def m13_delivery_days(m: Commerce) -> DataFrame:
    return delivered_times(m).agg(
        F.count("*").alias("valid_delivery_order_count"),
        mean_days("delivery_micros").alias("average_delivery_days"))


def is_late():
    return F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")


def m14_late_rate(m: Commerce) -> DataFrame:
    return delivered_times(m).agg(
        F.count("*").alias("evaluable_order_count"), count_if(is_late()).alias("late_order_count"),
        ratio(count_if(is_late()), F.count("*")).alias("late_delivery_rate"))


def delivered_reviews(m: Commerce) -> DataFrame:
    return C.latest_review(C.valid_reviews(m)).join(delivered_orders(m).select("order_id"), "order_id", "left_semi")


def m15_review_score(m: Commerce) -> DataFrame:
    return delivered_reviews(m).agg(F.count("*").alias("reviewed_order_count"),
                                    exact_mean("review_score").alias("average_review_score"))


def m16_positive_rate(m: Commerce) -> DataFrame:
    good = count_if(F.col("review_score") >= 4)
    return delivered_reviews(m).agg(
        F.count("*").alias("reviewed_order_count"), good.alias("positive_review_order_count"),
        ratio(good, F.count("*")).alias("positive_review_rate"))


def _cancellation(orders):
    canceled = count_if(F.col("order_status") == "canceled")
    return orders.agg(F.count("*").alias("total_order_count"), canceled.alias("canceled_order_count"),
                      ratio(canceled, F.count("*")).alias("cancellation_rate"))


def m17_cancel_rate(m: Commerce) -> DataFrame:
    return _cancellation(C.clean_orders_core(m).groupBy())


def m17_cancel_monthly(m: Commerce) -> DataFrame:
    return _cancellation(C.clean_orders_core(m).groupBy(month_of("order_purchase_timestamp").alias("order_month")))


def metric_category_item_base(m: Commerce) -> DataFrame:
    """Delivered items with month and source-language category (blank becomes unknown)."""
    name = F.col("product_category_name")
    return (C.sellable_items(m)
            .join(delivered_orders(m).select("order_id", "order_purchase_timestamp"), "order_id")
            .join(m.products.select("product_id", "product_category_name"), "product_id")
            .select("order_id", "order_item_id", "product_id", "order_purchase_timestamp",
                    month_of("order_purchase_timestamp").alias("purchase_month"),
                    F.when(name.isNull() | (name == ""), "unknown").otherwise(name).alias("product_category"),
                    "price"))


def _category_share(items: DataFrame) -> DataFrame:
    sales = items.groupBy("product_category").agg(F.sum("price").alias("sales"))
    total = scalar(sales.agg(F.sum("sales").alias("total")), "total")["total"]
    return sales.select("product_category", dbl("sales").alias("category_sales_amount"),
                        dbl(total).alias("total_category_sales_amount"),
                        ratio("sales", total).alias("category_sales_share"))


def m18_category_share(m: Commerce) -> DataFrame:
    return _category_share(metric_category_item_base(m))


def category_share_filtered(m: Commerce, first_day: str, last_day: str) -> DataFrame:
    """M18 inside a window of purchase dates (both ends included)."""
    items = metric_category_item_base(m)
    return _category_share(items.where(
        F.to_date("order_purchase_timestamp").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))))


def metric_order_base(m: Commerce) -> DataFrame:
    """One row per clean order with every flag the M metrics need."""
    orders = C.clean_orders(m).join(m.customers.select("customer_id", "customer_unique_id", "customer_state"), "customer_id")
    reviews = C.latest_review(C.valid_reviews(m)).select("order_id", "review_score")
    done = delivered()
    span = F.when(done & (F.col("order_delivered_customer_date") >= F.col("order_purchase_timestamp")),
                  micros_between("order_delivered_customer_date", "order_purchase_timestamp"))
    return (orders.join(order_paid(m), "order_id", "left").join(reviews, "order_id", "left")
            .select("order_id", "customer_unique_id", "customer_state", "order_status", "order_purchase_timestamp",
                    month_of("order_purchase_timestamp").alias("purchase_month"),
                    F.coalesce(F.col("amount"), F.lit(0)).alias("order_gmv"),
                    flag(done).alias("is_delivered"),
                    flag(done & (F.col("amount") > 0)).alias("is_paid_delivered"),
                    flag(F.col("order_status") == "canceled").alias("is_canceled"),
                    span.alias("delivery_micros"),
                    flag(span.isNotNull()).alias("is_delivery_evaluable"),
                    flag(span.isNotNull() & is_late()).alias("is_late"),
                    F.when(done, F.col("review_score")).alias("review_score"),
                    flag(done & (F.col("review_score") >= 4)).alias("is_positive_review")))


def metric_order_base_report(m: Commerce) -> DataFrame:
    return (metric_order_base(m).withColumn("order_gmv", dbl("order_gmv"))
            .withColumn("delivery_days", F.col("delivery_micros") / MICROS_PER_DAY).drop("delivery_micros"))


def _user_sums(base: DataFrame, *by: str) -> DataFrame:
    """Everything the metric reports add up, per user (and period): one pass over the orders,
    merged map-side, after which users are counted without a distinct."""
    done = F.col("is_delivered") == 1
    ts = F.when(done, F.col("order_purchase_timestamp"))
    return base.groupBy(*by, "customer_unique_id").agg(
        F.count("*").alias("orders"), F.sum("is_delivered").alias("valid"), F.sum("is_paid_delivered").alias("paid"),
        F.sum(F.when(F.col("is_paid_delivered") == 1, F.col("order_gmv"))).alias("gmv"),
        F.count("delivery_micros").alias("timed"), F.sum(F.col("delivery_micros").cast("decimal(20,0)")).alias("micros"),
        F.sum("is_delivery_evaluable").alias("evaluable"), F.sum("is_late").alias("late"),
        F.count("review_score").alias("reviewed"), F.sum("review_score").alias("points"),
        F.sum("is_positive_review").alias("positive"), F.sum("is_canceled").alias("canceled"),
        micros_between(F.max(ts), F.min(ts)).alias("span"))


def _metric_columns():
    """The metrics of a report, from user sums."""
    s, active = F.sum, count_if(F.col("valid") > 0)
    repeat = count_if(F.col("valid") >= 2)
    return [
        s("orders").alias("total_order_count"), s("valid").alias("valid_order_count"), s("paid").alias("paid_order_count"),
        dbl(F.coalesce(s("gmv"), F.lit(0))).alias("gmv"), ratio(s("gmv"), s("paid")).alias("average_order_value"),
        active.alias("active_customer_count"), (ratio(s("micros"), s("timed")) / MICROS_PER_DAY).alias("average_delivery_days"),
        ratio(s("late"), s("evaluable")).alias("late_delivery_rate"), ratio(s("points"), s("reviewed")).alias("average_review_score"),
        ratio(s("positive"), s("reviewed")).alias("positive_review_rate"), s("canceled").alias("canceled_order_count"),
        ratio(s("canceled"), s("orders")).alias("cancellation_rate"), repeat.alias("repeat_customer_count"),
        ratio(repeat, active).alias("repeat_purchase_rate")]


def metric_monthly_trends(m: Commerce) -> DataFrame:
    """Monthly M01-M08 and M13-M17; a metric without a denominator stays NULL. New users are
    those whose first delivered month it is, found among a user's months."""
    from pyspark.sql import Window as W
    users = _user_sums(metric_order_base(m), "purchase_month")
    done = F.when(F.col("valid") > 0, F.col("purchase_month"))
    first = F.min(done).over(W.partitionBy("customer_unique_id"))
    return users.withColumn("first", first).groupBy("purchase_month").agg(
        *_metric_columns(), count_if(F.col("first") == F.col("purchase_month")).alias("new_customer_count"))


def metric_filtered(m: Commerce, first_day: str, last_day: str, states: list[str] | None = None) -> DataFrame:
    """M01-M08 and M10-M17 over a purchase-date window and a set of states."""
    base = metric_order_base(m).where(
        F.to_date("order_purchase_timestamp").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    if states:
        base = base.where(F.col("customer_state").isin(*states))
    s, active = F.sum, count_if(F.col("valid") > 0)
    return _user_sums(base).agg(
        *_metric_columns(), ratio(s("gmv"), count_if(F.col("gmv") > 0)).alias("customer_lifetime_value"),
        ratio(s("valid"), active).alias("average_purchase_frequency"),
        (ratio(s(F.col("span").cast("decimal(20,0)")), s("valid") - active) / MICROS_PER_DAY)
        .alias("average_repurchase_interval_days"))


def cohort_filtered(m: Commerce, cohort_from: str, cohort_to: str) -> DataFrame:
    return m09_retention(m, cohort_from, cohort_to)


# ------------------------------------------------------------ distributions

def histogram(values: DataFrame, value: str, max_bins: int = 35) -> DataFrame:
    """Equal-width histogram between the smallest and largest value, at most ``max_bins``
    bins and no more bins than distinct values."""
    v = dbl(value)
    counts = values.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    s = scalar(counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                          F.least(F.count("*"), F.lit(max_bins)).alias("bins")), "lo", "hi", "bins")
    width = (F.col("s.hi") - F.col("s.lo")) / F.col("s.bins")
    number = F.when(width > 0, F.least(F.floor(F.try_divide(F.col("v") - F.col("s.lo"), width)), F.col("s.bins") - 1)).otherwise(0)
    return (counts.withColumn("s", s).withColumn("bin", number.cast("bigint")).withColumn("w", width)
            .groupBy("bin").agg(F.min(F.col("s.lo") + F.col("bin") * F.col("w")).alias("bin_start"),
                                F.min(F.col("s.lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_end"),
                                F.sum("n").alias("user_count")))


def ltv_distribution(m: Commerce) -> DataFrame:
    return histogram(user_revenue(m), "revenue")


def frequency_distribution(m: Commerce) -> DataFrame:
    return user_order_counts(m).groupBy("valid_order_count").agg(F.count("*").alias("user_count"))


def purchase_gaps(orders: DataFrame) -> DataFrame:
    """Microseconds to the previous order of the same user.

    The ordering window runs inside a user's day; the first order of a day is linked
    to the user's previous active day through that day's last order. A user with a
    third of all orders is thus spread over the days of the history.
    """
    from pyspark.sql import Window as W
    ts = F.col("order_purchase_timestamp")
    rows = orders.select("customer_unique_id", "order_id", ts, F.to_date(ts).alias("day"))
    w = W.partitionBy("customer_unique_id", "day").orderBy(ts, "order_id")
    inner = rows.withColumn("prev", F.lag(ts).over(w))
    edges = rows.groupBy("customer_unique_id", "day").agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    w_user = W.partitionBy("customer_unique_id").orderBy("day")
    links = (edges.withColumn("prev", F.lag("last").over(w_user)).where(F.col("prev").isNotNull())
             .select("customer_unique_id", micros_between("first", "prev").alias("gap_micros")))
    return (inner.where(F.col("prev").isNotNull())
            .select("customer_unique_id", micros_between(ts, "prev").alias("gap_micros")).unionByName(links))


def interval_distribution(m: Commerce) -> DataFrame:
    days = purchase_gaps(delivered_users(m)).select((F.col("gap_micros") / MICROS_PER_DAY).alias("interval_days"))
    return histogram(days, "interval_days").withColumnRenamed("user_count", "interval_count")
