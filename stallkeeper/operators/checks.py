"""Check registers: named facts about the layers, compared with each other.

Facts are one-row aggregates; only those numbers are brought together, so a register costs
one pass per layer and its own plan stays tiny.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper.functions import (MICROS_PER_DAY, count_if, dbl, fences, half_up, materialize, micros_between, month_index,
                                   month_of, outside, ratio, scalar, stored)
from stallkeeper.operators import cleaning, customers, metrics, rfm, structure
from stallkeeper.sources.model import Commerce

# check name, fact, expected fact or constant, tolerance
Check = tuple[str, str, "str | float", float]


def register(facts: list[tuple[DataFrame, dict[str, Column]]], checks: list[Check]) -> DataFrame:
    long = []
    for df, numbers in facts:
        one = df.agg(*[dbl(v).alias(k) for k, v in numbers.items()])
        cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in numbers])
        long.append(one.select(F.explode(cells).alias("c")).select("c.*"))
    names = [k for _, numbers in facts for k in numbers]
    wide = reduce(DataFrame.unionByName, long).groupBy().agg(
        *[F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in names])
    value = lambda x: F.col(x) if isinstance(x, str) else F.lit(float(x))
    rows = F.array(*[F.struct(
        F.lit(f"V{i:02d}").alias("check_id"), F.lit(name).alias("check_name"), half_up(value(actual), 6).alias("actual_value"),
        half_up(value(expected), 6).alias("expected_value"), F.lit(float(tol)).alias("tolerance"))
        for i, (name, actual, expected, tol) in enumerate(checks, 1)])
    diff = half_up(F.col("actual_value") - F.col("expected_value"), 6)
    return wide.select(F.explode(rows).alias("r")).select("r.*").withColumn("difference", diff).withColumn(
        "status", F.when(F.abs(F.col("difference")) <= F.col("tolerance"), "PASS").otherwise("FAIL"))


def _nulls(*names: str) -> Column:
    return count_if(reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names]))


def _first(name: str) -> Column:
    return F.max(name)


def validate_rfm(m: Commerce, observation_date: str) -> DataFrame:
    d = materialize(rfm.rfm_detail(m, observation_date))
    orders = customers.observed_orders(m, observation_date).groupBy("customer_unique_id").agg(
        F.count("*").alias("n"), F.sum("order_gmv").alias("g"), F.sum("is_paid_order").alias("p"))
    users = d.groupBy("customer_unique_id").agg(F.count("*").alias("n"), F.countDistinct("rfm_segment").alias("s"))
    summary = rfm.rfm_segment_summary(m, observation_date, d)
    split = lambda v, s: d.groupBy(v).agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    bad = count_if(F.col("lo") != F.col("hi"))
    R, Q, M = F.col("r_score") >= 4, F.col("f_score") >= 4, F.col("m_score") >= 4
    order = F.when(~M, 5).when(R & Q, 1).when(R, 2).when(Q, 3).otherwise(4)
    scores = ("r_score", "f_score", "m_score")
    code = F.concat(*[F.col(c).cast("string") for c in scores])
    outside = reduce(lambda a, b: a | b, [~F.col(c).between(1, 5) for c in scores])
    facts = [
        (d, {"rows": F.count("*"), "null_users": _nulls("customer_unique_id"),
             "null_metrics": _nulls("recency_days", "frequency", "monetary"), "null_scores": _nulls(*scores),
             "bad_scores": count_if(outside), "bad_segment_names": count_if(~F.col("rfm_segment").isin(*rfm.SEGMENTS)),
             "frequency_sum": F.sum("frequency"), "monetary_sum": F.sum("monetary"),
             "repeat_flags": F.sum("is_repeat_customer"), "repeat_users": count_if(F.col("frequency") >= 2),
             "bad_dates": count_if(F.col("observation_date") != observation_date),
             "late_purchases": count_if(F.col("last_purchase_date") > F.lit(observation_date).cast("date")),
             "negative_metrics": count_if((F.col("recency_days") < 0) | (F.col("frequency") < 0) | (F.col("monetary") < 0)),
             "wrong_segments": count_if(F.col("rfm_segment_order") != order),
             "wrong_scores": count_if(F.col("rfm_score") != F.col("r_score") + F.col("f_score") + F.col("m_score")),
             "wrong_codes": count_if(F.col("rfm_code") != code), "distinct_frequencies": F.countDistinct("frequency"),
             "mean_frequency": ratio(F.sum("frequency"), F.count("*"))}),
        (orders, {"order_users": F.count("*"), "orders": F.sum("n"), "order_gmv": F.sum("g"),
                  "frequency_ratio": ratio(F.sum("n"), F.count("*")), "order_aov": ratio(F.sum("g"), F.sum("p"))}),
        (users, {"repeated_users": count_if(F.col("n") > 1), "multi_segment_users": count_if(F.col("s") > 1)}),
        (split("recency_days", "r_score"), {"split_recency": bad}),
        (split("frequency", "f_score"), {"split_frequency": bad}),
        (split("monetary", "m_score"), {"split_monetary": bad}),
        (summary, {"segment_users": F.sum("user_count"), "segment_orders": F.sum("valid_order_count"),
                   "segment_gmv": F.sum(F.col("gmv").cast("decimal(28,2)")), "user_shares": F.sum("user_share"),
                   "order_shares": F.sum("order_share"), "gmv_shares": F.sum("gmv_share"),
                   "segment_aov": ratio(F.sum(F.col("gmv").cast("decimal(28,2)")), F.sum("paid_order_count"))}),
        (rfm.rfm_frequency_map(m, observation_date, d), {"mapped_frequencies": F.count("*")}),
        (rfm.rfm_boundaries(m, observation_date, d), {"boundary_rows": F.count("*")}),
    ]
    return register(facts, [
        ("rows equal users of the window", "rows", "order_users", 0), ("no empty user", "null_users", 0, 0),
        ("no repeated user", "repeated_users", 0, 0), ("no empty metric", "null_metrics", 0, 0),
        ("no empty score", "null_scores", 0, 0), ("scores between 1 and 5", "bad_scores", 0, 0),
        ("equal recency, equal score", "split_recency", 0, 0), ("equal frequency, equal score", "split_frequency", 0, 0),
        ("equal monetary value, equal score", "split_monetary", 0, 0), ("one segment per user", "multi_segment_users", 0, 0),
        ("only known segments", "bad_segment_names", 0, 0), ("segment users add up", "segment_users", "rows", 0),
        ("segment orders add up", "segment_orders", "orders", 0), ("segment revenue adds up", "segment_gmv", "order_gmv", 0.01),
        ("user shares add up to 1", "user_shares", 1, 1e-8), ("order shares add up to 1", "order_shares", 1, 1e-8),
        ("revenue shares add up to 1", "gmv_shares", 1, 1e-8), ("frequencies add up to the orders", "frequency_sum", "orders", 0),
        ("monetary values add up to the revenue", "monetary_sum", "order_gmv", 0.01),
        ("repeat flag means two orders", "repeat_flags", "repeat_users", 0), ("one observation date", "bad_dates", 0, 0),
        ("no purchase after the observation date", "late_purchases", 0, 0), ("no negative metric", "negative_metrics", 0, 0),
        ("every frequency is mapped", "mapped_frequencies", "distinct_frequencies", 0),
        ("four boundaries for two metrics", "boundary_rows", 8, 0), ("segments follow the scores", "wrong_segments", 0, 0),
        ("score is the sum", "wrong_scores", 0, 0), ("code joins the scores", "wrong_codes", 0, 0),
        ("mean frequency equals orders per user", "mean_frequency", "frequency_ratio", 1e-6),
        ("order value equals revenue per paid order", "segment_aov", "order_aov", 1e-6)])


def _one_payment(m: Commerce) -> DataFrame:
    """Payments of an order as one row, for readers that only add them up."""
    return metrics.order_paid(m).select(
        "order_id", F.lit(1).alias("payment_sequential"), F.lit(None).cast("string").alias("payment_type"),
        F.lit(1).cast("bigint").alias("payment_installments"), F.col("amount").alias("payment_value"))


def validate_customer(m: Commerce) -> DataFrame:
    m = m.with_tables(payments=_one_payment(m)).held("orders_core", "payments", "customers")
    base = customers.customer_order_base(m)
    profile = materialize(customers.customer_profile(m, base))
    money = lambda c: F.sum(F.col(c).cast("decimal(28,2)"))
    place = lambda df, p: (df, {f"{p}_users": F.sum("unique_user_count"), f"{p}_gmv": money("gmv"),
                                f"{p}_user_shares": F.sum("user_share"), f"{p}_gmv_shares": F.sum("gmv_share")})
    slot = lambda df, p: (df, {f"{p}_orders": F.sum("valid_order_count"), f"{p}_gmv": money("gmv"),
                               f"{p}_order_shares": F.sum("order_share")})
    per_order = base.groupBy("order_id").agg(F.count("*").alias("n"), F.max("order_gmv").alias("g"), F.max("is_paid_order").alias("p"))
    facts = [
        (profile, {"users": F.count("*"), "distinct_users": F.countDistinct("customer_unique_id"),
                   "null_users": _nulls("customer_unique_id"), "lifetime_gmv": F.sum("lifetime_gmv")}),
        (per_order, {"orders": F.sum("n"), "distinct_orders": F.count("*"), "gmv": F.sum("g"), "paid_orders": F.sum("p")}),
        (metrics.paid_delivered(m), {"payment_orders": F.count("*"), "payment_gmv": F.sum("amount")}),
        place(customers.state_profile(m), "state"), place(customers.city_profile(m), "city"),
        slot(customers.hourly_behavior(m), "hour"), slot(customers.weekday_behavior(m), "weekday"),
        slot(customers.day_type_behavior(m), "daytype"),
        (customers.growth_periods(m), {"recent_months": _first("recent_month_count"), "prior_months": _first("prior_month_count")}),
    ]
    return register(facts, [
        ("profile has one row per user", "distinct_users", "users", 0), ("no empty user in the profile", "null_users", 0, 0),
        ("order base has one row per order", "distinct_orders", "orders", 0),
        ("user revenue equals order revenue", "lifetime_gmv", "gmv", 0.01), ("state users add up", "state_users", "users", 0),
        ("state revenue adds up", "state_gmv", "gmv", 0.01), ("city users add up", "city_users", "users", 0),
        ("city revenue adds up", "city_gmv", "gmv", 0.01), ("hourly orders add up", "hour_orders", "orders", 0),
        ("hourly revenue adds up", "hour_gmv", "gmv", 0.01), ("weekday orders add up", "weekday_orders", "orders", 0),
        ("weekday revenue adds up", "weekday_gmv", "gmv", 0.01), ("day type orders add up", "daytype_orders", "orders", 0),
        ("day type revenue adds up", "daytype_gmv", "gmv", 0.01), ("state user shares add up to 1", "state_user_shares", 1, 1e-8),
        ("city revenue shares add up to 1", "city_gmv_shares", 1, 1e-8), ("hourly shares add up to 1", "hour_order_shares", 1, 1e-8),
        ("weekday shares add up to 1", "weekday_order_shares", 1, 1e-8),
        ("payments are not multiplied by joins", "gmv", "payment_gmv", 0.01),
        ("paid orders equal orders with payment", "paid_orders", "payment_orders", 0),
        ("six recent months", "recent_months", 6, 0), ("six prior months", "prior_months", 6, 0)])


def _base_facts(base: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The metrics once more, from the order base (collapsed to users first)."""
    users = base.groupBy("customer_unique_id").agg(
        F.count("*").alias("all"), F.sum("is_delivered").alias("d"), F.sum("is_paid_delivered").alias("p"),
        F.sum(F.when(F.col("is_paid_delivered") == 1, F.col("order_gmv"))).alias("g"), F.sum("is_canceled").alias("c"),
        F.sum("is_delivery_evaluable").alias("e"), F.sum("is_late").alias("l"), F.count("review_score").alias("r"),
        F.sum("review_score").alias("s"), F.sum("is_positive_review").alias("pos"),
        F.sum(F.col("delivery_micros").cast("decimal(20,0)")).alias("t"),
        F.min(F.when(F.col("is_delivered") == 1, F.col("order_purchase_timestamp"))).alias("first"),
        F.max(F.when(F.col("is_delivered") == 1, F.col("order_purchase_timestamp"))).alias("last"))
    s = F.sum
    again = F.col("d") >= 2
    span = F.when(again, micros_between("last", "first")).cast("decimal(20,0)")
    return users, {
        "b_orders": s("all"), "b_valid": s("d"), "b_paid": s("p"), "b_gmv": s("g"), "b_canceled": s("c"),
        "b_active": count_if(F.col("d") > 0), "b_repeat": count_if(F.col("d") >= 2), "b_evaluable": s("e"), "b_late": s("l"),
        "b_reviewed": s("r"), "b_positive": s("pos"), "b_payers": count_if(F.col("g") > 0), "b_aov": ratio(s("g"), s("p")),
        "b_score": ratio(s("s"), s("r")), "b_ltv": ratio(s("g"), count_if(F.col("g") > 0)),
        "b_frequency": ratio(s("d"), count_if(F.col("d") > 0)), "b_repeat_rate": ratio(count_if(again), count_if(F.col("d") > 0)),
        "b_gaps": F.coalesce(s(F.when(again, F.col("d") - 1)), F.lit(0)),
        "b_gap_days": ratio(s(span), s(F.when(again, F.col("d") - 1))) / MICROS_PER_DAY,
        "b_days": ratio(s("t"), s("e")) / MICROS_PER_DAY, "b_late_rate": ratio(s("l"), s("e")),
        "b_positive_rate": ratio(s("pos"), s("r")), "b_cancel_rate": ratio(s("c"), s("all"))}


def _stored_model(m: Commerce) -> Commerce:
    """The model for a register of all metrics: orders with their delivery times, one payment row and one review per
    order, each held once, so that every metric reads a few narrow columns instead of the lines again. The other tables
    are plain projections of their sources, which are read as cheaply as copies of them."""
    narrow = m.with_tables(payments=_one_payment(m), reviews=cleaning.latest_review(cleaning.valid_reviews(m)))
    return narrow.held("orders", "payments", "reviews")


def _more_facts(source: Commerce, m: Commerce, base: DataFrame) -> list[tuple[DataFrame, dict[str, Column]]]:
    """What the register expects of months, grids, long tails and keys, from the order base and the tables."""
    done = base.where(F.col("is_delivered") == 1)
    first = done.groupBy("customer_unique_id").agg(F.min("order_purchase_timestamp").alias("t"))
    months = first.select(month_index(month_of("t")).alias("month")).groupBy("month").agg(F.count("*").alias("n"))
    ends = scalar(base.agg(F.max(month_index(month_of(F.when(F.col("is_delivered") == 1, F.col("order_purchase_timestamp"))))).alias("last"),
                           F.max(month_index(month_of("order_purchase_timestamp"))).alias("order")), "last", "order")
    months = months.withColumn("_ends", ends)
    timed = cleaning.delivery_times(cleaning.clean_orders(m))
    bounds = scalar(fences(timed.select("delivery_micros"), "delivery_micros"), "lower_bound", "upper_bound")
    timed = timed.where(metrics.delivered())
    clean = cleaning.clean_delivery(m).where(metrics.delivered())
    payments = cleaning.positive_payments(source).groupBy("order_id", "payment_sequential").agg(F.count("*").alias("n"))
    reviews = cleaning.representative_review(m).groupBy("order_id").agg(F.count("*").alias("n"))
    return [
        (months, {"b_first_months": F.count("*"), "b_grid_rows": F.sum(F.col("_ends.last") - F.col("month") + 1),
                  "b_tail": F.max(F.col("_ends.order") - F.col("_ends.last"))}),
        (timed, {"b_long_tail": F.sum(outside("delivery_micros", bounds)), "b_chronology": F.sum("has_chronology_error")}),
        (clean, {"m13_long_tail": F.sum("is_delivery_iqr_extreme"), "m13_chronology": F.sum("has_intermediate_chronology_error")}),
        (metrics.metric_category_item_base(m).groupBy("product_category").agg(F.count("*").alias("n")), {"b_categories": F.count("*")}),
        (payments, {"repeated_payment_keys": count_if(F.col("n") > 1)}), (reviews, {"repeated_reviews": count_if(F.col("n") > 1)}),
    ]


def validate_metrics(source: Commerce) -> DataFrame:
    """Every metric against an independent count from the order base, and against its relatives; then the keys below.
    A repeated payment key fails its check: the sums are right all the same, as payments are added up per order."""
    m = _stored_model(source)
    base = stored(metrics.metric_order_base(m).select(
        "customer_unique_id", "order_purchase_timestamp", "is_delivered", "is_paid_delivered", "order_gmv", "is_canceled",
        "is_delivery_evaluable", "is_late", "review_score", "is_positive_review", "delivery_micros"))
    one = lambda df, names: (df, {alias: _first(c) for alias, c in names.items()})
    kept = metrics.m09_retention(m)
    facts = [
        _base_facts(base), *_more_facts(source, m, base),
        one(metrics.m01_gmv(m), {"m01": "gmv"}), one(metrics.m02_valid_orders(m), {"m02": "valid_order_count"}),
        one(metrics.m03_aov(m), {"m03_orders": "paid_order_count", "m03_revenue": "paid_order_revenue", "m03": "average_order_value"}),
        one(metrics.m04_paid_orders(m), {"m04": "paid_order_count"}),
        one(metrics.m05_active_customers(m), {"m05": "active_customer_count"}),
        (metrics.m06_new_customers(m), {"m06_sum": F.sum("new_customer_count"), "m06_months": F.count("*")}),
        one(metrics.m07_repeat_customers(m), {"m07": "repeat_customer_count"}),
        one(metrics.m08_repeat_rate(m), {"m08_active": "active_customer_count", "m08_repeat": "repeat_customer_count",
                                         "m08_rate": "repeat_purchase_rate"}),
        (kept, {"m09_first_below_1": count_if((F.col("retention_month_number") == 0) & (F.col("customer_retention_rate") != 1)),
                "m09_too_many": count_if(F.col("retained_customer_count") > F.col("cohort_customer_count")),
                "m09_rows": F.count("*")}),
        one(metrics.m10_ltv(m), {"m10_users": "paying_customer_count", "m10_revenue": "total_customer_revenue", "m10": "customer_lifetime_value"}),
        one(metrics.m11_frequency(m), {"m11_orders": "valid_order_count", "m11_users": "active_customer_count", "m11": "average_purchase_frequency"}),
        one(metrics.m12_repurchase_interval(m), {"m12_users": "repeat_customer_count", "m12_gaps": "valid_interval_count",
                                                "m12_days": "average_repurchase_interval_days"}),
        one(metrics.m13_delivery_days(m), {"m13_orders": "valid_delivery_order_count", "m13_days": "average_delivery_days"}),
        one(metrics.m14_late_rate(m), {"m14_orders": "evaluable_order_count", "m14_late": "late_order_count",
                                       "m14_rate": "late_delivery_rate"}),
        one(metrics.m15_review_score(m), {"m15_orders": "reviewed_order_count", "m15": "average_review_score"}),
        one(metrics.m16_positive_rate(m), {"m16_orders": "reviewed_order_count", "m16_positive": "positive_review_order_count",
                                           "m16_rate": "positive_review_rate"}),
        one(metrics.m17_cancel_rate(m), {"m17_orders": "total_order_count", "m17_canceled": "canceled_order_count",
                                         "m17_rate": "cancellation_rate"}),
        (metrics.m17_cancel_monthly(m), {"m17_month_orders": F.sum("total_order_count"), "m17_month_canceled": F.sum("canceled_order_count")}),
        (metrics.m18_category_share(m), {"m18_shares": F.sum("category_sales_share"),
                                         "m18_sum": F.sum(F.col("category_sales_amount").cast("decimal(28,2)")),
                                         "m18_total": F.max("total_category_sales_amount"), "m18_rows": F.count("*")}),
    ]
    return register(facts, [
        ("M01 revenue", "m01", "b_gmv", 0.01), ("M02 valid orders", "m02", "b_valid", 0), ("M03 paid orders", "m03_orders", "b_paid", 0),
        ("M03 revenue equals M01", "m03_revenue", "m01", 0.01), ("M03 order value", "m03", "b_aov", 1e-6),
        ("M04 paid orders", "m04", "m03_orders", 0), ("M05 active users", "m05", "b_active", 0),
        ("M06 new users add up to active users", "m06_sum", "m05", 0), ("M07 repeat users", "m07", "b_repeat", 0),
        ("M08 active users equal M05", "m08_active", "m05", 0), ("M08 repeat users equal M07", "m08_repeat", "m07", 0),
        ("M09 first month is complete", "m09_first_below_1", 0, 0), ("M09 retained users within the cohort", "m09_too_many", 0, 0),
        ("M10 paying users", "m10_users", "b_payers", 0), ("M10 revenue equals M01", "m10_revenue", "m01", 0.01),
        ("M10 lifetime value", "m10", "b_ltv", 1e-6), ("M11 orders equal M02", "m11_orders", "m02", 0),
        ("M11 users equal M05", "m11_users", "m05", 0), ("M11 frequency", "m11", "b_frequency", 1e-6),
        ("M12 users equal M07", "m12_users", "m07", 0), ("M13 delivered orders", "m13_orders", "b_evaluable", 0),
        ("M14 orders equal M13", "m14_orders", "m13_orders", 0), ("M14 late orders", "m14_late", "b_late", 0),
        ("M15 reviewed orders", "m15_orders", "b_reviewed", 0), ("M15 score", "m15", "b_score", 1e-6),
        ("M16 reviewed orders equal M15", "m16_orders", "m15_orders", 0), ("M16 positive reviews", "m16_positive", "b_positive", 0),
        ("M17 all orders", "m17_orders", "b_orders", 0), ("M17 canceled orders", "m17_canceled", "b_canceled", 0),
        ("M17 monthly orders add up", "m17_month_orders", "m17_orders", 0),
        ("M17 monthly canceled orders add up", "m17_month_canceled", "m17_canceled", 0),
        ("M18 shares add up to 1", "m18_shares", 1, 1e-6), ("M18 sales add up", "m18_sum", "m18_total", 0.01),
        ("M06 first purchase months", "m06_months", "b_first_months", 0), ("M08 repeat rate", "m08_rate", "b_repeat_rate", 1e-6),
        ("M09 cohort months", "m09_rows", "b_grid_rows", 0), ("M09 months that orders run on behind the grid", "b_tail", 0, 2),
        ("M12 gaps", "m12_gaps", "b_gaps", 0), ("M12 days between purchases", "m12_days", "b_gap_days", 1e-6),
        ("M13 days", "m13_days", "b_days", 1e-6), ("M13 long tail is kept", "m13_long_tail", "b_long_tail", 0),
        ("M13 chronology errors are kept", "m13_chronology", "b_chronology", 0), ("M14 late rate", "m14_rate", "b_late_rate", 1e-6),
        ("M16 positive rate", "m16_rate", "b_positive_rate", 1e-6), ("M17 cancellation rate", "m17_rate", "b_cancel_rate", 1e-6),
        ("M18 categories", "m18_rows", "b_categories", 0), ("one review per order", "repeated_reviews", 0, 0),
        ("payment keys are unique", "repeated_payment_keys", 0, 0)])


def validate_dashboard_detail(m: Commerce, bounds=structure.BOUNDS) -> DataFrame:
    """Grain, attribution and totals of the payment detail (order by payment type)."""
    d = structure.payment_detail_base(m, bounds)
    cells = materialize(d.groupBy("order_id", "payment_type").agg(
        F.count("*").alias("n"), F.max("order_payment_amount").alias("order_amount"), F.sum("payment_gmv").alias("split"),
        F.sum("is_primary_payment_type").alias("main"), F.sum("primary_attributed_order_gmv").alias("attributed"),
        F.max("payment_share_of_order").alias("share"),
        _nulls("order_id", "customer_unique_id", "customer_state", "order_purchase_timestamp", "order_value_band",
               "payment_type", "primary_payment_type", "first_paid_purchase_month").alias("nulls")))
    orders = cells.groupBy("order_id").agg(F.max("order_amount").alias("order_amount"), F.sum("split").alias("split"),
                                           F.sum("main").alias("main"))
    facts = [
        (cells, {"rows": F.sum("n"), "repeated_keys": count_if(F.col("n") > 1), "nulls": F.sum("nulls"),
                 "non_positive": count_if((F.col("order_amount") <= 0) | (F.col("split") <= 0)), "split_gmv": F.sum("split"),
                 "attributed_gmv": F.sum("attributed"), "bad_shares": count_if(~F.col("share").between(0, 1))}),
        (orders, {"orders": F.count("*"), "order_gmv": F.sum("order_amount"), "bad_main": count_if(F.col("main") != 1),
                  "unbalanced_orders": count_if(F.abs(F.col("split") - F.col("order_amount")) > 0.05)}),
        (metrics.paid_delivered(m), {"paid_orders": F.count("*"), "paid_gmv": F.sum("amount")}),
    ]
    return register(facts, [
        ("one row per order and type", "repeated_keys", 0, 0), ("no empty key field", "nulls", 0, 0),
        ("amounts are positive", "non_positive", 0, 0), ("one main type per order", "bad_main", 0, 0),
        ("split revenue equals order revenue", "split_gmv", "order_gmv", 0.05),
        ("attributed revenue equals order revenue", "attributed_gmv", "order_gmv", 0.05),
        ("every order is balanced", "unbalanced_orders", 0, 0), ("shares between 0 and 1", "bad_shares", 0, 0),
        ("orders equal paid orders", "orders", "paid_orders", 0), ("revenue equals paid revenue", "order_gmv", "paid_gmv", 0.05)])


def validate_stage1(m: Commerce) -> DataFrame:
    """Grain and invariants of the order base, the retention grid and the category items."""
    o = metrics.metric_order_base(m).groupBy("order_id").agg(
        F.count("*").alias("n"), F.max("is_delivered").alias("d"), F.max("is_paid_delivered").alias("p"),
        F.max("order_gmv").alias("g"), F.max("delivery_micros").alias("t"), F.max("review_score").alias("s"),
        _nulls("order_id", "order_status", "order_purchase_timestamp", "purchase_month").alias("nulls"))
    r = metrics.m09_retention(m)
    items = metrics.metric_category_item_base(m)
    per_item = items.groupBy("order_id", "order_item_id").agg(F.count("*").alias("n"), F.sum("price").alias("s"),
                                                              _nulls("product_category").alias("nulls"))
    facts = [
        (o, {"orders": F.sum("n"), "repeated_orders": count_if(F.col("n") > 1), "order_nulls": F.sum("nulls"),
             "valid_orders": F.sum("d"), "gmv": F.sum(F.when(F.col("p") == 1, F.col("g"))),
             "negative_delivery": count_if(F.col("t") < 0), "bad_reviews": count_if(~F.col("s").between(1, 5))}),
        (metrics.m01_gmv(m), {"m01": _first("gmv")}), (metrics.m02_valid_orders(m), {"m02": _first("valid_order_count")}),
        (r.groupBy("cohort_month", "retention_month_number").agg(
            F.count("*").alias("n"), F.max("customer_retention_rate").alias("rate")),
         {"repeated_cells": count_if(F.col("n") > 1),
          "bad_first_month": count_if((F.col("retention_month_number") == 0) & (F.col("rate") != 1)),
          "bad_rates": count_if(~F.col("rate").between(0, 1))}),
        (per_item, {"item_rows": F.sum("n"), "repeated_items": count_if(F.col("n") > 1), "item_nulls": F.sum("nulls"),
                    "negative_prices": count_if(F.col("s") < 0), "item_sales": F.sum("s")}),
        (metrics.m18_category_share(m), {"m18_total": _first("total_category_sales_amount"), "m18_shares": F.sum("category_sales_share")}),
    ]
    return register(facts, [
        ("one row per order", "repeated_orders", 0, 0), ("no empty key field", "order_nulls", 0, 0),
        ("valid orders equal M02", "valid_orders", "m02", 0), ("revenue equals M01", "gmv", "m01", 0.01),
        ("no negative delivery span", "negative_delivery", 0, 0), ("scores between 1 and 5", "bad_reviews", 0, 0),
        ("one row per cohort and month", "repeated_cells", 0, 0), ("first month is complete", "bad_first_month", 0, 0),
        ("rates between 0 and 1", "bad_rates", 0, 0), ("one row per item", "repeated_items", 0, 0),
        ("no empty category", "item_nulls", 0, 0), ("no negative price", "negative_prices", 0, 0),
        ("item sales equal M18", "item_sales", "m18_total", 0.01), ("category shares add up to 1", "m18_shares", 1, 1e-9)])
