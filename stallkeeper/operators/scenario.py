"""What-if estimates: a baseline measured on the fact tables times assumed rates.

Every baseline is one row; the scenarios are unfolded from an array of the rates that
the caller passes, so no join is involved. None of this is a forecast.
"""
from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from stallkeeper.functions import (count_if, dbl, global_rank, half_up, materialize, ratio, scalar, sum_if,
                                   nth_row_per_key, stored, tile)
from stallkeeper.operators import cleaning as C
from stallkeeper.operators.category import category_items
from stallkeeper.operators.customers import customer_order_base, market_potential, observed_orders
from stallkeeper.operators.kpi import monthly_kpi
from stallkeeper.operators.metrics import order_paid
from stallkeeper.operators.rfm import SEGMENTS, rfm_detail
from stallkeeper.operators.structure import ALL, order_type_amounts, paid_orders, payment_structure
from stallkeeper.sources.model import Commerce

USER = "customer_unique_id"
# The assumed rates per scenario.
REPEAT_UPLIFT = {"conservative": 0.10, "neutral": 0.20, "optimistic": 0.30}
AOV_UPLIFT = {"conservative": 0.03, "neutral": 0.05, "optimistic": 0.08}
RECALL = {"conservative": 0.30, "neutral": 0.45, "optimistic": 0.60}
BASKET_UPLIFT = {"conservative": 0.10, "neutral": 0.20, "optimistic": 0.30}
DELIVERY_CUT = {"conservative": 0.05, "neutral": 0.10, "optimistic": 0.15}
REGION_UPLIFT = {"conservative": 0.05, "neutral": 0.10, "optimistic": 0.15}
PAYMENT_SHIFT = {"conservative": 0.02, "neutral": 0.05, "optimistic": 0.10}
NON_TOP3_UPLIFT = {"conservative": 0.015, "neutral": 0.03, "optimistic": 0.05}


def _scenarios(base: DataFrame, rates: Mapping[str, float]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(float(v)).alias("rate")) for k, v in rates.items()])
    return base.withColumn("_s", F.explode(cells)).select("*", "_s.scenario", "_s.rate").drop("_s")


def second_orders(orders: DataFrame) -> DataFrame:
    """Second order of every user; at most two rows per user leave each map task."""
    return nth_row_per_key(orders.select(USER, "order_purchase_timestamp", "order_id", "order_gmv"), [USER],
                           [F.col("order_purchase_timestamp"), F.col("order_id")], 2)


def _mean(c):
    return ratio(F.sum(c), F.count(c))


def scenario_repeat(m: Commerce, observation_date: str, rates: Mapping[str, float] = REPEAT_UPLIFT,
                    base: DataFrame | None = None, second: DataFrame | None = None) -> DataFrame:
    """More single-purchase users come back: their number x repeat rate x uplift x mean value
    of a second order. ``base`` and ``second`` may bring the order base and the second orders stored."""
    orders = observed_orders(m, observation_date, base)
    users = orders.groupBy(USER).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("users"), count_if(F.col("n") >= 2).alias("repeat_users"))
    value = scalar((second_orders(orders) if second is None else second).agg(_mean("order_gmv").alias("v")), "v")["v"]
    base = users.select(
        (F.col("users") - F.col("repeat_users")).alias("target_users"),
        ratio("repeat_users", "users").alias("formal_repeat_rate"), value.alias("historical_second_order_avg_gmv"))
    s = _scenarios(base, rates)
    expected = F.col("target_users") * F.col("formal_repeat_rate")
    return s.select(
        "scenario", "target_users", "formal_repeat_rate", F.col("rate").alias("assumed_relative_uplift"),
        expected.alias("baseline_expected_repeat_users"), (expected * F.col("rate")).alias("incremental_repeat_users"),
        "historical_second_order_avg_gmv",
        half_up(expected * F.col("rate") * F.col("historical_second_order_avg_gmv"), 6).alias("simulated_incremental_gmv"))


def scenario_aov(m: Commerce, first_month: str, last_month: str, rates: Mapping[str, float] = AOV_UPLIFT) -> DataFrame:
    """A higher order value at unchanged paid orders over a range of months."""
    k = monthly_kpi(m).where(F.col("month").between(first_month, last_month))
    base = k.agg(dbl(F.sum(F.col("gmv").cast("decimal(28,2)"))).alias("baseline_gmv"),
                 F.sum("order_count").alias("baseline_paid_orders")).withColumn(
        "baseline_aov", ratio("baseline_gmv", "baseline_paid_orders"))
    s = _scenarios(base, rates).withColumn("simulated_aov", F.col("baseline_aov") * (1 + F.col("rate")))
    s = s.withColumn("sim", F.col("baseline_paid_orders") * F.col("simulated_aov"))
    return s.select("scenario", "baseline_gmv", "baseline_paid_orders", "baseline_aov",
                    F.col("rate").alias("assumed_aov_uplift"), "simulated_aov", half_up("sim", 6).alias("simulated_gmv"),
                    half_up(F.col("sim") - F.col("baseline_gmv"), 6).alias("simulated_incremental_gmv"))


def scenario_recall(m: Commerce, observation_date: str, segment: str = SEGMENTS[3],
                    rates: Mapping[str, float] = RECALL, base: DataFrame | None = None,
                    second: DataFrame | None = None) -> DataFrame:
    """Win back one value segment: its users x repeat share x coefficient x mean second order."""
    target = materialize(rfm_detail(m, observation_date, orders=base).where(F.col("rfm_segment") == segment).select(USER, "frequency"))
    second = second_orders(observed_orders(m, observation_date, base)) if second is None else second
    second = second.join(target.select(USER), USER, "left_semi")
    value = scalar(second.agg(_mean("order_gmv").alias("v")), "v")["v"]
    base = target.agg(F.count("*").alias("target_users"),
                      count_if(F.col("frequency") >= 2).alias("historical_repeat_users")).select(
        "*", ratio("historical_repeat_users", "target_users").alias("historical_repeat_share"),
        value.alias("historical_second_order_avg_gmv"))
    s = _scenarios(base, rates)
    potential = F.col("target_users") * F.col("historical_repeat_share")
    back = potential * F.col("rate")
    return s.select(
        "scenario", "target_users", "historical_repeat_users", "historical_repeat_share",
        potential.alias("historical_potential_recall_users"), F.col("rate").alias("assumed_recall_coefficient"),
        back.alias("simulated_reactivated_users"), "historical_second_order_avg_gmv",
        half_up(back * F.col("historical_second_order_avg_gmv"), 6).alias("simulated_incremental_gmv"))


def scenario_basket(m: Commerce, rates: Mapping[str, float] = BASKET_UPLIFT, items: DataFrame | None = None) -> DataFrame:
    """More orders with several products, valued at the gap to single-product orders."""
    items = category_items(m) if items is None else items
    products = (items.groupBy("order_id", "product_id").agg(F.lit(1).alias("one"))
                .groupBy("order_id").agg(F.count("*").alias("products")))
    orders = products.join(order_paid(m), "order_id", "left")
    one, many = F.col("products") == 1, F.col("products") > 1
    mean = lambda c: ratio(F.sum(F.when(c, F.col("amount"))), count_if(c & F.col("amount").isNotNull()))
    base = orders.agg(
        count_if(one).alias("single_product_orders"), count_if(many).alias("multi_product_orders"),
        mean(one).alias("single_product_avg_gmv"), mean(many).alias("multi_product_avg_gmv")).withColumn(
        "historical_value_gap", F.col("multi_product_avg_gmv") - F.col("single_product_avg_gmv"))
    new = F.col("multi_product_orders") * F.col("rate")
    return _scenarios(base, rates).select(
        "scenario", "single_product_orders", "multi_product_orders", "single_product_avg_gmv", "multi_product_avg_gmv",
        "historical_value_gap", F.col("rate").alias("assumed_multi_order_uplift"), new.alias("simulated_new_multi_orders"),
        half_up(new * F.col("historical_value_gap"), 6).alias("simulated_incremental_gmv"))


def scenario_delivery(m: Commerce, rates: Mapping[str, float] = DELIVERY_CUT, items: DataFrame | None = None) -> DataFrame:
    """Shorter deliveries per category. Reviewed orders are ranked by (days, order id) into four
    equal groups as ``ntile(4)`` does; a shortened order is compared with the slowest day of each
    group and, where it reaches a faster one, takes over that group's historical means.

    A category may hold most orders, so the ranking is cut into order-preserving cells."""
    items = category_items(m) if items is None else items
    pairs = items.groupBy("order_id", "category_name").agg(F.lit(1).alias("one")).drop("one")
    orders = C.delivery_times(C.clean_orders(m).where("order_status = 'delivered'")).select("order_id", "delivery_micros")
    review = C.latest_review(C.valid_reviews(m)).select("order_id", "review_score")
    rows = materialize(pairs.join(orders, "order_id").join(review, "order_id").select(
        "category_name", "order_id", "delivery_micros", "review_score"))
    rows = global_rank(rows, ["category_name"], "delivery_micros", "order_id").withColumn(
        "g", tile(F.col("rank"), F.col("n"), 4))
    # Orders of a category with the same span, score and group behave alike from here on.
    cells = materialize(rows.groupBy("category_name", "g", "delivery_micros", "review_score").agg(F.count("*").alias("k")))
    group = cells.groupBy("category_name", "g").agg(
        F.max("delivery_micros").alias("top"), F.sum("k").alias("size"),
        F.sum(F.col("review_score") * F.col("k")).alias("points"), sum_if(F.col("review_score") == 1, "k").alias("ones"))
    at = lambda i, c: F.max(F.when(F.col("g") == i, F.col(c)))
    stats = group.groupBy("category_name").agg(
        F.sum("size").alias("review_orders"), F.sum("points").alias("points"), F.sum("ones").alias("ones"),
        *[at(i, "top").alias(f"top{i}") for i in range(1, 5)],
        *[F.max(F.when(F.col("g") == i, ratio("points", "size"))).alias(f"score{i}") for i in range(1, 5)],
        *[F.max(F.when(F.col("g") == i, ratio("ones", "size"))).alias(f"ones{i}") for i in range(1, 5)])
    moved = _scenarios(cells.join(stats.select("category_name", "top1", "top2", "top3"), "category_name"), rates)
    shorter = F.col("delivery_micros") * (1 - F.col("rate"))
    to = (F.when(shorter <= F.col("top1"), 1).when(shorter <= F.col("top2"), 2).when(shorter <= F.col("top3"), 3)
          .otherwise(4))
    per = moved.withColumn("to", to).groupBy("category_name", "scenario", "rate").agg(
        sum_if(F.col("to") < F.col("g"), "k").alias("affected_orders"),
        *[sum_if(F.col("to") == i, "k").alias(f"in{i}") for i in range(1, 5)])
    j = per.join(stats, "category_name")
    part = lambda kind, i: F.coalesce(F.col(f"in{i}") * F.col(f"{kind}{i}"), F.lit(0.0))
    mix = lambda kind: ratio(reduce(lambda x, y: x + y, [part(kind, i) for i in range(1, 5)]), "review_orders")
    score, ones = ratio("points", "review_orders"), ratio("ones", "review_orders")
    return j.select(
        "category_name", "scenario", "review_orders", half_up(score, 6).alias("baseline_avg_score"),
        half_up(ones, 6).alias("baseline_one_star_rate"), F.col("rate").alias("assumed_delivery_reduction"),
        "affected_orders", half_up(ratio("affected_orders", "review_orders"), 6).alias("affected_order_share"),
        half_up(mix("score"), 6).alias("historical_reference_avg_score"),
        half_up(mix("score") - score, 6).alias("historical_reference_score_gap"),
        half_up(mix("ones"), 6).alias("historical_reference_one_star_rate"),
        half_up(mix("ones") - ones, 6).alias("historical_reference_one_star_rate_gap"))


def scenario_region(m: Commerce, excluded: list[str], rates: Mapping[str, float] = REGION_UPLIFT,
                    base: DataFrame | None = None) -> DataFrame:
    """Growth in candidate states: eligible, outside the leading ones, and either large with low
    spend or medium-sized and growing fast."""
    c = market_potential(m, base=base).where(
        ~F.col("customer_state").isin(*excluded) & F.col("is_sample_eligible")
        & (F.col("is_large_scale_low_spend") | F.col("is_medium_scale_fast_growth")))
    base = c.agg(
        F.count("*").alias("candidate_state_count"),
        F.concat_ws(",", F.array_sort(F.collect_list("customer_state"))).alias("candidate_states"),
        F.concat(F.min("recent_start_month"), F.lit("_to_"), F.max("recent_end_month")).alias("baseline_window"),
        dbl(F.sum(F.col("recent_gmv").cast("decimal(28,2)"))).alias("candidate_recent_gmv"))
    extra = F.col("candidate_recent_gmv") * F.col("rate")
    return _scenarios(base, rates).select(
        "scenario", "candidate_state_count", "candidate_states", "baseline_window", "candidate_recent_gmv",
        F.col("rate").alias("assumed_gmv_uplift"), half_up(extra, 6).alias("simulated_incremental_gmv"),
        half_up(F.col("candidate_recent_gmv") + extra, 6).alias("simulated_candidate_gmv"))


def scenario_payment_shift(m: Commerce, payment_type: str = "credit_card",
                           rates: Mapping[str, float] = PAYMENT_SHIFT, orders: DataFrame | None = None) -> DataFrame:
    """Part of the revenue moves from one payment type to others; the total does not change."""
    p = payment_structure(m, orders=orders).where((F.col("period") == ALL) & (F.col("payment_type") == payment_type)).select(
        "total_gmv", "total_paid_orders", F.col("split_gmv").alias("type_gmv"),
        ratio("split_gmv", "total_gmv").alias("type_gmv_share"), F.col("primary_order_count").alias("type_primary_orders"),
        ratio("primary_order_count", "total_paid_orders").alias("type_order_share"))
    return _scenarios(p, rates).select(
        "scenario", *p.columns, F.col("rate").alias("assumed_share_reduction_pp"),
        half_up(F.col("total_gmv") * F.col("rate"), 6).alias("simulated_shifted_gmv"),
        half_up(F.col("type_gmv_share") - F.col("rate"), 9).alias("simulated_type_share"),
        F.lit(0.0).alias("simulated_incremental_gmv"))


def scenario_non_top3(m: Commerce, month: str, rates: Mapping[str, float] = NON_TOP3_UPLIFT,
                      orders: DataFrame | None = None) -> DataFrame:
    """Growth outside the three largest states, on the revenue of one month."""
    orders = paid_orders(m) if orders is None else orders
    states = orders.groupBy("customer_state").agg(
        F.sum("order_payment_amount").alias("gmv"), F.count("*").alias("orders"),
        F.sum(F.when(F.col("purchase_month") == month, F.col("order_payment_amount"))).alias("month_gmv"),
        count_if(F.col("purchase_month") == month).alias("month_orders"))
    ranked = states.withColumn("r", F.row_number().over(W.partitionBy().orderBy(F.desc("gmv"), "customer_state")))
    base = ranked.agg(
        dbl(F.sum("month_gmv")).alias("baseline_month_gmv"), ratio(F.sum("month_gmv"), F.sum("month_orders")).alias("baseline_aov"),
        ratio(F.sum(F.when(F.col("r") > 3, F.col("gmv"))), F.sum("gmv")).alias("non_top3_share"))
    pool = F.col("baseline_month_gmv") * F.col("non_top3_share")
    extra = pool * F.col("rate")
    total = F.col("baseline_month_gmv") + extra
    return _scenarios(base, rates).select(
        "scenario", "baseline_month_gmv", "baseline_aov", half_up("non_top3_share", 9).alias("non_top3_share"),
        half_up(pool, 6).alias("target_pool_gmv"), F.col("rate").alias("assumed_gmv_uplift"),
        half_up(extra, 6).alias("simulated_incremental_gmv"), half_up(extra / F.col("baseline_aov"), 6).alias("simulated_incremental_orders"),
        half_up(total, 6).alias("simulated_total_gmv"), half_up((pool + extra) / total, 9).alias("simulated_non_top3_share"))


def scenario_effects(m: Commerce, observation_date: str, aov_months: tuple[str, str], excluded: list[str],
                     month: str) -> DataFrame:
    """All scenarios as one long table. Joined once and stored: payments added up per order and type, the order base,
    the paid orders with their split, the users' second orders, and the products and categories of each order."""
    paid = order_type_amounts(m).select(
        "order_id", F.lit(1).alias("payment_sequential"), "payment_type", F.lit(1).cast("bigint").alias("payment_installments"),
        F.col("amount").alias("payment_value"))
    m = m.with_tables(payments=paid).held("orders", "payments")
    base = stored(customer_order_base(m).select(
        USER, "customer_id", "order_id", "order_purchase_timestamp", "purchase_date", "purchase_month", "customer_state",
        "customer_city", "order_gmv", "is_paid_order"))
    paid_base = stored(paid_orders(m).select(
        "order_id", "customer_state", "purchase_month", "comparable_period", "order_payment_amount", "is_mixed_payment",
        "primary_payment_type", "split"))
    second = materialize(second_orders(observed_orders(m, observation_date, base)))
    items = stored(category_items(m).select("order_id", "product_id", "category_name").distinct())

    def rows(df: DataFrame, name: str, metric: str, value: str, gmv: str, reference: str, scope: str | None = None):
        return df.select(
            F.lit(name).alias("effect_type"), "scenario", (F.col(scope) if scope else F.lit("all")).alias("target_scope"),
            F.lit(metric).alias("primary_metric"), dbl(value).alias("primary_effect_value"),
            (dbl(gmv) if gmv else F.lit(None).cast("double")).alias("simulated_incremental_gmv"),
            dbl(reference).alias("reference_value"))
    parts = [
        rows(scenario_repeat(m, observation_date, base=base, second=second), "repeat_purchase_growth", "incremental_repeat_users",
             "incremental_repeat_users", "simulated_incremental_gmv", "historical_second_order_avg_gmv"),
        rows(scenario_aov(m, *aov_months), "aov_growth", "simulated_aov", "simulated_aov", "simulated_incremental_gmv",
             "baseline_aov"),
        rows(scenario_recall(m, observation_date, base=base, second=second), "retention_user_recall", "simulated_reactivated_users",
             "simulated_reactivated_users", "simulated_incremental_gmv", "historical_second_order_avg_gmv"),
        rows(scenario_basket(m, items=items), "basket_structure", "simulated_new_multi_orders", "simulated_new_multi_orders",
             "simulated_incremental_gmv", "historical_value_gap"),
        rows(scenario_delivery(m, items=items), "delivery_experience", "orders_crossing_to_faster_reference_group", "affected_orders",
             "", "historical_reference_score_gap", "category_name"),
        rows(scenario_region(m, excluded, base=base), "regional_pilot_growth", "simulated_candidate_gmv", "simulated_candidate_gmv",
             "simulated_incremental_gmv", "candidate_recent_gmv", "candidate_states"),
        rows(scenario_payment_shift(m, orders=paid_base), "payment_structure_shift", "simulated_shifted_gmv", "simulated_shifted_gmv",
             "simulated_incremental_gmv", "type_gmv_share"),
        rows(scenario_non_top3(m, month, orders=paid_base), "non_top3_region_growth", "simulated_non_top3_share", "simulated_non_top3_share",
             "simulated_incremental_gmv", "non_top3_share"),
    ]
    out = reduce(DataFrame.unionByName, parts)
    for c in ("primary_effect_value", "simulated_incremental_gmv", "reference_value"):
        out = out.withColumn(c, half_up(c, 6))
    return out
