"""Customer layers (order and user grain), time behaviour and regional markets."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from stallkeeper.functions import (MICROS_PER_DAY, half_up, calendar, count_if, dbl, flag, iso_weekday, literal_rows, materialize,
                                   micros_between, month_of, ratio, scalar)
from stallkeeper.operators.cleaning import positive_payments
from stallkeeper.operators.metrics import order_paid
from stallkeeper.sources.model import Commerce


def customer_order_base(m: Commerce, payments: DataFrame | None = None, delivery: bool = False) -> DataFrame:
    """One row per delivered order with its user, date parts and revenue (0 if unpaid).
    ``order_gmv`` stays decimal so that later sums are exact.

    ``payments`` may replace the default order totals by a wider frame (one row per order,
    revenue in ``amount``) whose other columns are kept; ``delivery`` keeps the delivery times.
    """
    ts = F.col("order_purchase_timestamp")
    source = m.orders if delivery else m.orders_core
    payments = order_paid(m) if payments is None else payments
    extra = [c for c in payments.columns if c not in ("order_id", "amount")]
    if delivery:
        extra += ["order_delivered_customer_date", "order_estimated_delivery_date"]
    orders = source.where((F.col("order_status") == "delivered") & F.col("order_id").isNotNull()
                          & ts.isNotNull() & F.col("order_estimated_delivery_date").isNotNull())
    who = m.customers.where(F.col("customer_unique_id").isNotNull()
                            & (F.trim(F.col("customer_unique_id").cast("string")) != ""))
    return (orders.join(who, "customer_id").join(payments, "order_id", "left").select(
        "customer_unique_id", "customer_id", "order_id", ts,
        F.to_date(ts).alias("purchase_date"), month_of(ts).alias("purchase_month"),
        F.hour(ts).cast("bigint").alias("purchase_hour"), iso_weekday(ts).alias("weekday_number"),
        "customer_state", "customer_city",
        F.coalesce(F.col("amount"), F.lit(0)).alias("order_gmv"),
        flag(F.col("amount") > 0).alias("is_paid_order"), *extra))


def customer_order_base_report(m: Commerce) -> DataFrame:
    return customer_order_base(m).withColumn("order_gmv", dbl("order_gmv"))


def latest_address():
    """State and city of the latest order (ties: greatest order id, then customer id)."""
    pick = F.max_by(F.struct("customer_state", "customer_city"),
                    F.struct("order_purchase_timestamp", "order_id", "customer_id"))
    return pick.alias("_address")


def customer_profile(m: Commerce, base: DataFrame | None = None) -> DataFrame:
    """One row per user. Months of activity come from a user-month pre-aggregate, so a user
    with very many orders is merged map-side and no distinct set is built per user."""
    base = customer_order_base(m) if base is None else base
    ts = F.col("order_purchase_timestamp")
    monthly = base.groupBy("customer_unique_id", "purchase_month").agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("orders"),
        F.sum("is_paid_order").alias("paid"), F.sum("order_gmv").alias("gmv"),
        F.max(F.struct("order_purchase_timestamp", "order_id", "customer_id", "customer_state", "customer_city"))
        .alias("latest"))
    users = monthly.groupBy("customer_unique_id").agg(
        F.min("first").alias("first_purchase_timestamp"), F.max("last").alias("last_purchase_timestamp"),
        F.sum("orders").alias("valid_order_count"), F.sum("paid").alias("paid_order_count"),
        F.sum("gmv").alias("lifetime_gmv"), F.count("*").alias("active_purchase_months"),
        F.max("latest").alias("latest"))
    span = micros_between("last_purchase_timestamp", "first_purchase_timestamp")
    return users.select(
        "customer_unique_id", "first_purchase_timestamp", "last_purchase_timestamp",
        month_of("first_purchase_timestamp").alias("first_purchase_month"),
        month_of("last_purchase_timestamp").alias("latest_purchase_month"),
        "valid_order_count", "paid_order_count", "lifetime_gmv",
        ratio("lifetime_gmv", "paid_order_count").alias("average_order_value"),
        span.alias("lifecycle_micros"), (span / MICROS_PER_DAY).alias("customer_lifecycle_days"),
        "active_purchase_months", flag(F.col("valid_order_count") >= 2).alias("is_repeat_customer"),
        F.col("latest.customer_state").alias("customer_state"), F.col("latest.customer_city").alias("customer_city"))


def customer_profile_report(m: Commerce) -> DataFrame:
    return customer_profile(m).withColumn("lifetime_gmv", dbl("lifetime_gmv")).drop("lifecycle_micros")


def _place_profile(m: Commerce, places: list[str]) -> DataFrame:
    """Ranks need one ordered task, but only over one row per place."""
    by = customer_profile(m).groupBy(*places).agg(
        F.count("*").alias("unique_user_count"), F.sum("valid_order_count").alias("valid_order_count"),
        F.sum("paid_order_count").alias("paid_order_count"), F.sum("lifetime_gmv").alias("gmv"))
    everything = W.partitionBy()
    users, gmv = F.sum("unique_user_count").over(everything), F.sum("gmv").over(everything)
    return by.select(
        *places, "unique_user_count", ratio("unique_user_count", users).alias("user_share"),
        "valid_order_count", "paid_order_count", dbl("gmv").alias("gmv"), ratio("gmv", gmv).alias("gmv_share"),
        ratio("gmv", "unique_user_count").alias("spend_per_user"),
        ratio("gmv", "paid_order_count").alias("average_order_value"),
        F.rank().over(everything.orderBy(F.desc("unique_user_count"))).cast("bigint").alias("user_rank"),
        F.rank().over(everything.orderBy(F.desc("gmv"))).cast("bigint").alias("gmv_rank"))


def state_profile(m: Commerce) -> DataFrame:
    return _place_profile(m, ["customer_state"])


def city_profile(m: Commerce) -> DataFrame:
    return _place_profile(m, ["customer_state", "customer_city"])


def _by_slot(base: DataFrame, slot) -> DataFrame:
    """Orders, users and revenue per time slot, counted per user first."""
    per_user = base.groupBy(slot.alias("slot"), "customer_unique_id").agg(
        F.count("*").alias("orders"), F.sum("is_paid_order").alias("paid"), F.sum("order_gmv").alias("gmv"))
    return per_user.groupBy("slot").agg(
        F.sum("orders").alias("valid_order_count"), F.count("*").alias("unique_user_count"),
        F.sum("paid").alias("paid_order_count"), F.sum("gmv").alias("gmv"))


def _slot_report(slots: DataFrame, stats: DataFrame, keep: list[str]) -> DataFrame:
    """Dense report over a fixed list of slots; totals come from the same few rows."""
    joined = slots.join(stats, "slot", "left").na.fill(0, ["valid_order_count", "unique_user_count", "paid_order_count"])
    joined = joined.withColumn("gmv", F.coalesce(F.col("gmv"), F.lit(0).cast("decimal(38,2)")))
    everything = W.partitionBy()
    return joined.select(
        *keep, "valid_order_count",
        ratio("valid_order_count", F.sum("valid_order_count").over(everything)).alias("order_share"),
        "unique_user_count", "paid_order_count", dbl("gmv").alias("gmv"),
        ratio("gmv", F.sum("gmv").over(everything)).alias("gmv_share"),
        ratio("gmv", "paid_order_count").alias("average_order_value"))


def hourly_behavior(m: Commerce) -> DataFrame:
    hours = m.spark.range(24).select(F.col("id").alias("slot"), F.col("id").alias("hour"))
    return _slot_report(hours, _by_slot(customer_order_base(m), F.col("purchase_hour")), ["hour"])


WEEKDAYS = [(1, "Monday"), (2, "Tuesday"), (3, "Wednesday"), (4, "Thursday"), (5, "Friday"), (6, "Saturday"),
            (7, "Sunday")]


def weekday_behavior(m: Commerce) -> DataFrame:
    days = literal_rows(m.spark, "slot bigint, weekday_name string", WEEKDAYS).withColumn("weekday_number", F.col("slot"))
    return _slot_report(days, _by_slot(customer_order_base(m), F.col("weekday_number")), ["weekday_number", "weekday_name"])


def day_type_column():
    return F.when(F.col("weekday_number") >= 6, "Weekend").otherwise("Weekday")


def calendar_day_types(spark, first, last) -> DataFrame:
    """Calendar days per day type between two dates (ends included)."""
    days = calendar(spark, first, last, "day", "d")
    return days.groupBy(F.when(F.weekday("d") >= 5, "Weekend").otherwise("Weekday").alias("slot")).agg(
        F.count("*").alias("calendar_day_count"))


def day_type_behavior(m: Commerce) -> DataFrame:
    """Weekday against weekend, with calendar days as the denominator of daily averages."""
    base = customer_order_base(m)
    range_ = scalar(base.agg(F.min("purchase_date").alias("first"), F.max("purchase_date").alias("last")), "first", "last")
    slots = literal_rows(m.spark, "slot string, day_type_order bigint", [("Weekday", 1), ("Weekend", 2)])
    days = calendar_day_types(m.spark, range_["first"], range_["last"])
    report = _slot_report(slots.join(days, "slot").withColumn("day_type", F.col("slot")),
                          _by_slot(base, day_type_column()), ["day_type_order", "day_type", "calendar_day_count"])
    return report.where("valid_order_count > 0").withColumn(
        "average_daily_orders", ratio("valid_order_count", "calendar_day_count"))


# ------------------------------------------------------------ regional growth

def _growth_periods(months: DataFrame, length: int) -> DataFrame:
    """Recent and prior window from the observed months, the first and last month left out.
    One row per observed month goes in, so the ordered step is tiny."""
    w = W.partitionBy().orderBy(F.desc("month"))
    inner = (months.withColumn("n", F.count("*").over(W.partitionBy())).withColumn("rank", F.row_number().over(w))
             .where((F.col("rank") > 1) & (F.col("rank") < F.col("n")))
             .withColumn("rank", F.col("rank") - 1))
    recent, prior = F.col("rank") <= length, F.col("rank").between(length + 1, 2 * length)
    pick = lambda c, f: f(F.when(c, F.col("month")))
    return inner.agg(
        pick(recent, F.min).alias("recent_start_month"), pick(recent, F.max).alias("recent_end_month"),
        pick(prior, F.min).alias("prior_start_month"), pick(prior, F.max).alias("prior_end_month"),
        count_if(recent).alias("recent_month_count"), count_if(prior).alias("prior_month_count"))


def growth_periods(m: Commerce, length: int = 6) -> DataFrame:
    base = customer_order_base(m)
    return _growth_periods(base.select(F.col("purchase_month").alias("month")).distinct(), length)


def market_growth_base(m: Commerce, length: int = 6, base: DataFrame | None = None) -> DataFrame:
    """Recent against prior window per state, counted per user and month first."""
    base = customer_order_base(m) if base is None else base
    user_months = materialize(base.groupBy(
        "customer_state", "customer_unique_id", "purchase_month").agg(
        F.count("*").alias("orders"), F.sum("is_paid_order").alias("paid"), F.sum("order_gmv").alias("gmv")))
    p = _growth_periods(user_months.select(F.col("purchase_month").alias("month")).distinct(), length)
    row = scalar(p, *p.columns)
    bounds = ["prior_start_month", "prior_end_month", "recent_start_month", "recent_end_month"]
    month = F.col("purchase_month")
    tagged = user_months.withColumn("p", row).where(
        month.between(F.col("p.prior_start_month"), F.col("p.recent_end_month"))).withColumn(
        "is_recent", month.between(F.col("p.recent_start_month"), F.col("p.recent_end_month")))
    per_user = tagged.groupBy("customer_state", "customer_unique_id", "is_recent").agg(
        F.sum("orders").alias("orders"), F.sum("paid").alias("paid"), F.sum("gmv").alias("gmv"))
    new, old = F.col("is_recent"), ~F.col("is_recent")
    zero = lambda c: F.coalesce(c, F.lit(0))
    s = per_user.groupBy("customer_state").agg(
        count_if(old).alias("prior_unique_users"), count_if(new).alias("recent_unique_users"),
        *[zero(F.sum(F.when(cond, F.col(c)))).alias(f"{label}_{name}")
          for c, name in (("orders", "valid_orders"), ("paid", "paid_orders"), ("gmv", "gmv"))
          for label, cond in (("prior", old), ("recent", new))])
    everything = W.partitionBy()
    growth = lambda c: ratio(dbl(f"recent_{c}") - dbl(f"prior_{c}"), f"prior_{c}")
    return s.withColumn("p", row).select(
        "customer_state", *[F.col(f"p.{b}").alias(b) for b in bounds],
        "prior_unique_users", "recent_unique_users", "prior_valid_orders", "recent_valid_orders",
        "prior_paid_orders", "recent_paid_orders", dbl("prior_gmv").alias("prior_gmv"), dbl("recent_gmv").alias("recent_gmv"),
        ratio("recent_gmv", "recent_unique_users").alias("recent_spend_per_user"),
        growth("unique_users").alias("user_growth_rate"), growth("gmv").alias("gmv_growth_rate"),
        ratio("recent_unique_users", F.sum("recent_unique_users").over(everything)).alias("recent_user_share"),
        ratio("recent_gmv", F.sum("recent_gmv").over(everything)).alias("recent_gmv_share"))


# The label texts of the market report.
TOO_SMALL = "样本不足（不做潜力判断）"
NO_TYPE = "未命中重点类型"
MARKET_TYPES = {"is_large_scale_low_spend": "规模较大但人均消费较低",
                "is_medium_scale_fast_growth": "当前规模中等但增长较快",
                "is_high_spend_low_penetration": "人均消费较高但渗透规模较小"}


def market_potential(m: Commerce, length: int = 6, base: DataFrame | None = None) -> DataFrame:
    """Label promising states by quartiles of the states with enough users in both windows.
    One row per state, so the ranking runs in one small task."""
    a = W.partitionBy()
    q = lambda c, p: F.percentile(c, F.lit(p)).over(a)
    users, prior = F.col("recent_unique_users"), F.col("prior_unique_users")
    df = (market_growth_base(m, length, base)
          .withColumn("sample_prior_user_threshold", F.ceil(q(F.when(prior > 0, prior), 0.25)).cast("bigint"))
          .withColumn("sample_recent_user_threshold", F.ceil(q(F.when(users > 0, users), 0.25)).cast("bigint"))
          .withColumn("is_sample_eligible", (prior >= F.col("sample_prior_user_threshold"))
                      & (users >= F.col("sample_recent_user_threshold"))))
    ok = lambda c: F.when(F.col("is_sample_eligible"), F.col(c))
    stats = {"eligible_recent_users_q25": ("recent_unique_users", 0.25),
             "eligible_recent_users_median": ("recent_unique_users", 0.5),
             "eligible_recent_users_q75": ("recent_unique_users", 0.75),
             "eligible_spend_per_user_median": ("recent_spend_per_user", 0.5),
             "eligible_spend_per_user_q75": ("recent_spend_per_user", 0.75),
             "eligible_user_share_median": ("recent_user_share", 0.5),
             "eligible_user_growth_median": ("user_growth_rate", 0.5),
             "eligible_gmv_growth_median": ("gmv_growth_rate", 0.5)}
    for name, (c, p) in stats.items():
        df = df.withColumn(name, q(ok(c), p))
    spend, ug, gg = F.col("recent_spend_per_user"), F.col("user_growth_rate"), F.col("gmv_growth_rate")
    rules = {
        "is_large_scale_low_spend": (users >= F.col("eligible_recent_users_median"))
        & (spend < F.col("eligible_spend_per_user_median")),
        "is_medium_scale_fast_growth": (users >= F.col("eligible_recent_users_q25"))
        & (users < F.col("eligible_recent_users_q75")) & (ug >= F.col("eligible_user_growth_median"))
        & (gg >= F.col("eligible_gmv_growth_median")),
        "is_high_spend_low_penetration": (spend >= F.col("eligible_spend_per_user_q75"))
        & (F.col("recent_user_share") < F.col("eligible_user_share_median"))}
    for name, rule in rules.items():
        df = df.withColumn(name, F.col("is_sample_eligible") & F.coalesce(rule, F.lit(False)))
    text = F.concat_ws("；", *[F.when(F.col(n), t) for n, t in MARKET_TYPES.items()])
    rank = lambda c: F.rank().over(a.orderBy(F.col(c).desc_nulls_last())).cast("bigint")
    rounded = [half_up(n, 8).alias(n) for n in stats]
    kept = [c for c in df.columns if c not in stats]
    return df.select(
        *kept, *rounded, half_up((ug + gg) / 2, 8).alias("growth_strength"),
        F.when(~F.col("is_sample_eligible"), TOO_SMALL).when(text == "", NO_TYPE).otherwise(text).alias("potential_market_type"),
        rank("recent_unique_users").alias("recent_user_rank"), rank("recent_gmv").alias("recent_gmv_rank"),
        rank("user_growth_rate").alias("user_growth_rank"), rank("gmv_growth_rate").alias("gmv_growth_rank"))


# ------------------------------------------------------------ audits

def observed_orders(m: Commerce, observation_date: str, base: DataFrame | None = None, **kw) -> DataFrame:
    """Customer order base up to and including the observation date."""
    return (customer_order_base(m, **kw) if base is None else base).where(F.col("purchase_date") <= F.lit(observation_date).cast("date"))


def order_base_audit(m: Commerce, observation_date: str) -> DataFrame:
    """Grain, key, coverage and payment facts of the order base around the cut-off."""
    base = customer_order_base(m)
    per_order = base.groupBy("order_id").agg(F.count("*").alias("n"))
    o = scalar(per_order.agg(count_if(F.col("n") > 1).alias("dup"), F.count("*").alias("orders")), "dup", "orders")
    before = F.col("purchase_date") <= F.lit(observation_date).cast("date")
    users = base.groupBy("customer_unique_id").agg(F.max(before).alias("b"), *[
        x.alias(n) for n, x in {
            "rows": F.count("*"), "before": count_if(before),
            "first": F.min("order_purchase_timestamp"), "last": F.max("order_purchase_timestamp"),
            "no_state": count_if(before & F.col("customer_state").isNull()),
            "no_city": count_if(before & F.col("customer_city").isNull()),
            "paid": count_if(before & (F.col("is_paid_order") == 1)),
            "no_gmv": count_if(before & (F.col("order_gmv") <= 0))}.items()])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    # The base leaves out orders without a user, so those are counted in front of it.
    nobody = F.col("customer_unique_id").isNull() | (F.trim(F.col("customer_unique_id").cast("string")) == "")
    missing = (m.orders_core.where(F.col("order_status") == "delivered").join(
        m.customers.select("customer_id", "customer_unique_id"), "customer_id", "left").agg(
        count_if(nobody).alias("missing")))
    return users.agg(
        total("rows").alias("row_count"), F.max(scalar(missing, "missing")["missing"]).alias("missing_users"),
        F.min("first").alias("first_purchase"), F.max("last").alias("last_purchase"),
        total("before").alias("orders_before_cutoff"), (total("rows") - total("before")).alias("orders_after_cutoff"),
        count_if(F.col("b")).alias("users_before_cutoff"), total("no_state").alias("missing_state"),
        total("no_city").alias("missing_city"), total("paid").alias("paid_orders"),
        total("no_gmv").alias("zero_gmv_orders")).select(
        "*", o["orders"].alias("distinct_orders"), o["dup"].alias("duplicated_orders"))


def _cutoff_payments(m: Commerce, observation_date: str) -> DataFrame:
    orders = customer_order_base(m).where(F.col("purchase_date") <= F.lit(observation_date).cast("date"))
    return positive_payments(m).join(orders.select("order_id"), "order_id", "left_semi")


def payment_source_reconcile(m: Commerce, observation_date: str) -> DataFrame:
    """Per payment type: rows, orders and value of the positive payments inside the cut-off,
    with the number of orders whose revenue differs from its payments."""
    rows = _cutoff_payments(m, observation_date)
    per_type = rows.groupBy("payment_type", "order_id").agg(F.count("*").alias("n"), F.sum("payment_value").alias("v"))
    paid = rows.groupBy("order_id").agg(F.sum("payment_value").alias("v"), F.countDistinct("payment_type").alias("types"))
    orders = observed_orders(m, observation_date).select("order_id", "order_gmv", "is_paid_order")
    both = orders.join(paid, "order_id", "left")
    diff = F.abs(F.coalesce(F.col("v"), F.lit(0)) - F.col("order_gmv"))
    check = scalar(both.agg(count_if(diff > 0.01).alias("bad"), F.sum("is_paid_order").alias("paid"),
                            count_if(F.col("types") > 1).alias("mixed")), "bad", "paid", "mixed")
    return per_type.groupBy("payment_type").agg(
        F.sum("n").alias("payment_rows"), F.count("*").alias("orders"), dbl(F.sum("v")).alias("payment_value")).select(
        "*", check["bad"].alias("mismatched_orders"), check["paid"].alias("paid_orders"),
        check["mixed"].alias("mixed_payment_orders"))


def installment_audit(m: Commerce, observation_date: str) -> DataFrame:
    """Installments per payment type. Rows are collapsed to (order, type, installments) first;
    the median works on counts of the few installment values."""
    rows = _cutoff_payments(m, observation_date)
    cells = rows.groupBy("payment_type", "order_id", "payment_installments").agg(F.count("*").alias("n"))
    groups = cells.groupBy("payment_type", "order_id").agg(F.sum("n").alias("rows"), F.count("*").alias("values"))
    by_order = groups.groupBy("payment_type").agg(
        F.count("*").alias("orders"), count_if(F.col("rows") > 1).alias("groups_with_multiple_rows"),
        count_if(F.col("values") > 1).alias("ambiguous_groups"))
    i = F.col("payment_installments")
    values = cells.groupBy("payment_type", i).agg(F.sum("n").alias("n"))
    tally = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    by_row = values.groupBy("payment_type").agg(
        F.sum("n").alias("payment_rows"), F.min(i).alias("min_installments"),
        F.percentile(i, F.lit(0.5), F.col("n")).alias("median_installments"), F.max(i).alias("max_installments"),
        tally(i == 0).alias("zero_installment_rows"), tally(i == 1).alias("one_installment_rows"),
        tally(i > 1).alias("multi_installment_rows"))
    return by_row.join(by_order, "payment_type")
