"""Churn (no purchase for more than 90 days, or another threshold) against value, experience and structure."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from stallkeeper.functions import count_if, dbl, flag, half_up, materialize, micros_between, ratio, scalar
from stallkeeper.operators.cleaning import latest_review, valid_reviews
from stallkeeper.operators.customers import calendar_day_types, day_type_column, observed_orders
from stallkeeper.operators.structure import order_payment_summary
from stallkeeper.sources.model import Commerce

THRESHOLD = 90


def status():
    return F.when(F.col("churn_flag") == 1, "Churned").otherwise("Non-churned")


def _recency(last, observation_date: str):
    return F.date_diff(F.lit(observation_date).cast("date"), last).cast("bigint")


def order_experience(m: Commerce, observation_date: str) -> DataFrame:
    """Observed orders with representative review, delivery span and delay flag (NULL where the
    order cannot be judged)."""
    orders = observed_orders(m, observation_date, delivery=True)
    review = latest_review(valid_reviews(m)).select(
        "order_id", "review_id", "review_score", "review_creation_date", "review_answer_timestamp")
    bought, arrived, promised = (F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date"),
                                 F.col("order_estimated_delivery_date"))
    usable = arrived >= bought
    return (orders.join(review, "order_id", "left")
            .withColumn("delivery_micros", F.when(usable, micros_between(arrived, bought)))
            .withColumn("is_delayed", F.when(usable & promised.isNotNull(), flag(arrived > promised))))


def churn_users(m: Commerce, observation_date: str, threshold: int = THRESHOLD) -> DataFrame:
    """Everything the churn reports need per user, in one aggregate over the orders."""
    reviewed = F.col("review_score")
    users = order_experience(m, observation_date).groupBy("customer_unique_id").agg(
        F.min("order_purchase_timestamp").alias("first_purchase_timestamp"),
        F.max("order_purchase_timestamp").alias("last_purchase_timestamp"),
        F.count("*").alias("valid_order_count"), F.sum("is_paid_order").alias("paid_order_count"),
        F.sum("order_gmv").alias("lifetime_gmv"),
        F.max(F.struct("order_purchase_timestamp", "order_id", "customer_id", "order_gmv", "customer_state",
                       "customer_city")).alias("latest"),
        F.count(reviewed).alias("review_orders"), F.sum(reviewed).alias("review_points"),
        F.count("delivery_micros").alias("delivery_orders"),
        F.sum(F.col("delivery_micros").cast("decimal(20,0)")).alias("delivery_micros"),
        F.count("is_delayed").alias("delay_eligible_orders"),
        F.coalesce(F.sum("is_delayed"), F.lit(0)).alias("delayed_orders"))
    last = F.to_date("last_purchase_timestamp")
    return (users.withColumn("recency_days", _recency(last, observation_date))
            .withColumn("customer_lifecycle_days", F.date_diff(last, F.to_date("first_purchase_timestamp")).cast("bigint"))
            .withColumn("is_repeat_customer", flag(F.col("valid_order_count") >= 2))
            .withColumn("churn_flag", flag(F.col("recency_days") > threshold)))


def churn_comparison(m: Commerce, observation_date: str, threshold: int = THRESHOLD) -> DataFrame:
    u = churn_users(m, observation_date, threshold)
    n, orders, paid, gmv = F.count("*"), F.sum("valid_order_count"), F.sum("paid_order_count"), F.sum("lifetime_gmv")
    days = F.try_divide(ratio(F.sum("delivery_micros"), F.sum("delivery_orders")), F.lit(86_400_000_000.0))
    by = u.groupBy("churn_flag").agg(
        n.alias("user_count"), orders.alias("total_valid_orders"), paid.alias("total_paid_orders"),
        half_up(gmv, 2).alias("total_gmv"), half_up(ratio(gmv, n), 2).alias("spend_per_user"),
        half_up(ratio(orders, n), 4).alias("avg_purchase_frequency"), F.sum("is_repeat_customer").alias("repeat_users"),
        half_up(100 * ratio(F.sum("is_repeat_customer"), n), 2).alias("repeat_rate_pct"),
        half_up(ratio(F.sum("customer_lifecycle_days"), n), 2).alias("avg_lifecycle_days"),
        half_up(ratio(gmv, paid), 2).alias("average_order_value"),
        F.count("latest.order_gmv").alias("users_with_latest_order_amount"),
        half_up(ratio(F.sum("latest.order_gmv"), F.count("latest.order_gmv")), 2).alias("avg_latest_order_amount"),
        orders.alias("order_count"), F.sum("review_orders").alias("review_order_count"),
        (orders - F.sum("review_orders")).alias("excluded_review_orders"),
        half_up(ratio(F.sum("review_points"), F.sum("review_orders")), 3).alias("avg_review_score"),
        F.sum("delivery_orders").alias("delivery_order_count"),
        (orders - F.sum("delivery_orders")).alias("excluded_delivery_orders"), half_up(days, 2).alias("avg_delivery_days"),
        F.sum("delay_eligible_orders").alias("delay_eligible_orders"),
        (orders - F.sum("delay_eligible_orders")).alias("excluded_delay_orders"),
        F.sum("delayed_orders").alias("delayed_orders"),
        half_up(100 * ratio(F.sum("delayed_orders"), F.sum("delay_eligible_orders")), 2).alias("delay_rate_pct"))
    total = F.sum("user_count").over(W.partitionBy())  # two rows
    return by.withColumn("user_share_pct", half_up(100 * ratio("user_count", total), 2)).withColumn(
        "churn_status", status()).drop("churn_flag")


def churn_user_detail(m: Commerce, observation_date: str, threshold: int = THRESHOLD) -> DataFrame:
    return churn_users(m, observation_date, threshold).select(
        "customer_unique_id", "first_purchase_timestamp", "last_purchase_timestamp", "valid_order_count",
        "paid_order_count", half_up("lifetime_gmv", 2).alias("lifetime_gmv"),
        half_up(ratio("lifetime_gmv", "paid_order_count"), 2).alias("average_order_value"), "recency_days",
        "customer_lifecycle_days", "is_repeat_customer", "churn_flag", F.lit(observation_date).alias("observation_date"),
        half_up("latest.order_gmv", 2).alias("latest_order_amount"),
        F.col("latest.customer_state").alias("customer_state"), F.col("latest.customer_city").alias("customer_city"),
        half_up(ratio("review_points", "review_orders"), 3).alias("avg_review_score"),
        half_up(ratio("delivery_micros", "delivery_orders") / 86_400_000_000.0, 2).alias("avg_delivery_days"),
        "delay_eligible_orders", "delayed_orders",
        half_up(100 * ratio("delayed_orders", "delay_eligible_orders"), 2).alias("delay_rate_pct"))


# ------------------------------------------------------------ structure

def _user_cells(orders: DataFrame, dim: str, observation_date: str, threshold: int = THRESHOLD) -> DataFrame:
    """Orders per user and value of a dimension, with the churn flag of the user. The window
    over a user covers one row per value, so no join back to the orders is needed."""
    cells = orders.groupBy("customer_unique_id", dim).agg(
        F.count("*").alias("orders"), F.sum("is_paid_order").alias("paid"), F.sum("order_gmv").alias("gmv"),
        F.max("purchase_date").alias("last"))
    last = F.max("last").over(W.partitionBy("customer_unique_id"))
    return cells.withColumn("churn_flag", flag(_recency(last, observation_date) > threshold))


def churn_by_payment(m: Commerce, observation_date: str, threshold: int = THRESHOLD) -> DataFrame:
    pay = order_payment_summary(m).select("order_id", F.col("order_payment_amount").alias("amount"), "primary_payment_type")
    cells = _user_cells(observed_orders(m, observation_date, payments=pay), "primary_payment_type", observation_date, threshold)
    by = cells.where(F.col("primary_payment_type").isNotNull()).groupBy("churn_flag", "primary_payment_type").agg(
        F.sum("orders").alias("order_count"), F.count("*").alias("users_using_payment_type"))
    total = F.sum("order_count").over(W.partitionBy("churn_flag"))
    return by.select(status().alias("churn_status"), "primary_payment_type", "order_count",
                     half_up(100 * ratio("order_count", total), 2).alias("order_share_pct"), "users_using_payment_type")


def _users_by_place(m: Commerce, observation_date: str, place, name: str, threshold: int = THRESHOLD) -> DataFrame:
    orders = observed_orders(m, observation_date)
    users = orders.groupBy("customer_unique_id").agg(
        F.max(F.struct("order_purchase_timestamp", "order_id", "customer_id", "customer_state", "customer_city"))
        .alias("l"), F.max("purchase_date").alias("last"))
    by = (users.select(F.col("l.customer_state").alias("customer_state"), F.col("l.customer_city").alias("customer_city"),
                       flag(_recency(F.col("last"), observation_date) > threshold).alias("churn_flag"))
          .groupBy(place.alias(name)).agg(F.count("*").alias("user_count"), F.sum("churn_flag").alias("churned_users")))
    a = W.partitionBy()  # one row per place
    rate = 100 * ratio("churned_users", "user_count")
    overall = 100 * ratio(F.sum("churned_users").over(a), F.sum("user_count").over(a))
    return by.select(
        name, "user_count", "churned_users", (F.col("user_count") - F.col("churned_users")).alias("non_churned_users"),
        half_up(rate, 2).alias("churn_rate_pct"),
        half_up(100 * ratio("user_count", F.sum("user_count").over(a)), 2).alias("user_share_pct"),
        half_up(rate - overall, 2).alias("churn_rate_vs_overall_pct_point"))


def churn_by_state(m: Commerce, observation_date: str, threshold: int = THRESHOLD) -> DataFrame:
    return _users_by_place(m, observation_date, F.col("customer_state"), "customer_state", threshold)


def churn_by_city_top30(m: Commerce, observation_date: str, n: int = 30, threshold: int = THRESHOLD) -> DataFrame:
    """The n cities (named with their state) with most users."""
    place = F.concat_ws(" | ", "customer_city", "customer_state")
    return _users_by_place(m, observation_date, place, "customer_city_state", threshold).orderBy(
        F.desc("user_count"), "customer_city_state").limit(n)


def churn_state_ranking(m: Commerce, observation_date: str, n: int = 10, threshold: int = THRESHOLD) -> DataFrame:
    return churn_by_state(m, observation_date, threshold).select(
        "customer_state", "user_count", "churned_users", "non_churned_users", "churn_rate_pct", "user_share_pct"
    ).orderBy(F.desc("user_count"), "customer_state").limit(n)


def churn_by_day_type(m: Commerce, observation_date: str, start_date: str, threshold: int = THRESHOLD) -> DataFrame:
    orders = observed_orders(m, observation_date).withColumn("day_type", day_type_column())
    by = _user_cells(orders, "day_type", observation_date, threshold).groupBy("churn_flag", "day_type").agg(
        F.sum("orders").alias("order_count"), F.count("*").alias("users_with_orders"),
        F.sum("paid").alias("paid_order_count"), F.sum("gmv").alias("gmv"))
    days = calendar_day_types(m.spark, F.lit(start_date).cast("date"), F.lit(observation_date).cast("date"))
    total = F.sum("order_count").over(W.partitionBy("churn_flag"))
    return by.join(days.withColumnRenamed("slot", "day_type"), "day_type").select(
        status().alias("churn_status"), "day_type", "calendar_day_count", "order_count",
        half_up(ratio("order_count", "calendar_day_count"), 2).alias("orders_per_calendar_day"),
        half_up(100 * ratio("order_count", total), 2).alias("order_share_pct"), "users_with_orders", "paid_order_count",
        half_up("gmv", 2).alias("gmv"), half_up(ratio("gmv", "paid_order_count"), 2).alias("average_order_value"))


def churn_by_first_month(m: Commerce, observation_date: str, threshold: int = THRESHOLD) -> DataFrame:
    """Cohorts by first month, with the users who had the whole threshold to churn in. Younger
    cohorts are right-censored and must not be compared with older ones."""
    users = observed_orders(m, observation_date).groupBy("customer_unique_id").agg(
        F.min("purchase_date").alias("first"), F.max("purchase_date").alias("last"))
    latest = F.date_sub(F.lit(observation_date).cast("date"), threshold + 1)
    by = users.groupBy(F.date_format("first", "yyyy-MM").alias("first_purchase_month")).agg(
        F.count("*").alias("cohort_users"),
        count_if(_recency(F.col("last"), observation_date) > threshold).alias("churned_users"),
        count_if(F.col("first") <= latest).alias("users_with_full_90d_opportunity"))
    total = F.sum("cohort_users").over(W.partitionBy())  # one row per month
    return by.select(
        "first_purchase_month", "cohort_users", "churned_users",
        (F.col("cohort_users") - F.col("churned_users")).alias("non_churned_users"),
        half_up(100 * ratio("churned_users", "cohort_users"), 2).alias("churn_rate_pct"),
        "users_with_full_90d_opportunity", half_up(100 * ratio("cohort_users", total), 2).alias("user_share_pct"))


# ------------------------------------------------------------ association

def cramers_v(cells: DataFrame, feature: str) -> DataFrame:
    """Cramer's V of a contingency table given as (row, column, n). Cells that never occur
    still count: they are completed from the two short margins. ``cells`` is read three times: pass a stored one.
    Rows are meant to be few (here two)."""
    rows = cells.groupBy("row").agg(F.sum("n").alias("rt"))
    cols = cells.groupBy("column").agg(F.sum("n").alias("ct"))
    s = scalar(rows.agg(F.sum("rt").alias("n"), F.count("*").alias("r"), F.collect_list(F.struct("row", "rt")).alias("rows")),
               "n", "r", "rows")
    grid = (cols.withColumn("s", s).withColumn("x", F.explode("s.rows"))
            .select("column", "ct", F.col("x.row").alias("row"), F.col("x.rt").alias("rt"), F.col("s.n").alias("total"),
                    F.col("s.r").alias("r")))
    e = dbl("rt") * dbl("ct") / dbl("total")
    o = F.coalesce(dbl("n"), F.lit(0.0))
    chi = grid.join(cells, ["row", "column"], "left").agg(
        F.sum(F.try_divide((o - e) * (o - e), e)).alias("chi2"), F.max("total").alias("total"), F.max("r").alias("r"),
        F.countDistinct("column").alias("c"))
    k = F.least(F.col("r"), F.col("c")) - 1
    return chi.select(F.lit(feature).alias("feature"), F.lit("Cramer's V").alias("association_metric"),
                      half_up(F.sqrt(F.try_divide(F.col("chi2"), dbl(F.col("total") * k))), 4).alias("association_value"))


def churn_association(m: Commerce, observation_date: str, start_date: str, threshold: int = THRESHOLD) -> DataFrame:
    """Strength of association of churn with main payment type, state and day type."""
    pay = churn_by_payment(m, observation_date, threshold).select(
        F.col("churn_status").alias("row"), F.col("primary_payment_type").alias("column"), F.col("order_count").alias("n"))
    day = churn_by_day_type(m, observation_date, start_date, threshold).select(
        F.col("churn_status").alias("row"), F.col("day_type").alias("column"), F.col("order_count").alias("n"))
    halves = F.array(F.struct(F.lit("Churned").alias("row"), F.col("churned_users").alias("n")),
                     F.struct(F.lit("Non-churned").alias("row"), F.col("non_churned_users").alias("n")))
    state = churn_by_state(m, observation_date, threshold).select(
        F.col("customer_state").alias("column"), F.explode(halves).alias("h")).select("h.row", "column", "h.n")
    parts = [("Primary Payment Type", pay), ("Customer State", state), ("Weekday / Weekend", day)]
    return reduce(DataFrame.unionByName, [cramers_v(materialize(df), name) for name, df in parts])


# Report names of the compared features.
FEATURES = {"Spend per User": "spend_per_user", "Average Purchase Frequency": "avg_purchase_frequency",
            "Repeat Rate": "repeat_rate_pct", "Average Lifecycle Days": "avg_lifecycle_days",
            "Average Order Value": "average_order_value", "Latest Order Amount": "avg_latest_order_amount",
            "Average Review Score": "avg_review_score", "Average Delivery Days": "avg_delivery_days",
            "Delay Rate": "delay_rate_pct"}


def churn_feature_summary(m: Commerce, observation_date: str, start_date: str, threshold: int = THRESHOLD) -> DataFrame:
    """Every compared feature with both values and their difference, then the associations."""
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(c).alias("value")) for n, c in FEATURES.items()])
    at = lambda s: F.max(F.when(F.col("churn_status") == s, F.col("value")))
    means = (churn_comparison(m, observation_date, threshold).select("churn_status", F.explode(cells).alias("c"))
             .select("churn_status", "c.*").groupBy("feature").agg(
                 at("Churned").alias("churned_value"), at("Non-churned").alias("non_churned_value")))
    means = means.withColumn("difference", half_up(F.col("churned_value") - F.col("non_churned_value"), 6))
    return means.unionByName(churn_association(m, observation_date, start_date, threshold), allowMissingColumns=True)
