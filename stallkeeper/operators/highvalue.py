"""High-value users: value base, geography, payment, experience and consumption behaviour."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from stallkeeper.functions import count_if, dbl, flag, materialize, ratio, scalar, sum_if
from stallkeeper.operators.churn import THRESHOLD, churn_users, order_experience
from stallkeeper.operators.cleaning import positive_payments
from stallkeeper.operators.cohort import DORMANT, lifecycle_stage
from stallkeeper.operators.customers import calendar_day_types, day_type_column, observed_orders
from stallkeeper.operators.rfm import HIGH_VALUE, rfm_detail
from stallkeeper.operators.structure import value_band
from stallkeeper.sources.model import Commerce

USER = "customer_unique_id"
GROUPS = ("all_users", "high_value_users")
HIGH_AMOUNT = 500


def rfm_churn_crosscheck(m: Commerce, observation_date: str, threshold: int = THRESHOLD) -> DataFrame:
    """Do the RFM and the churn layer describe the same users with the same recency? One row."""
    r = rfm_detail(m, observation_date).select(
        USER, F.col("recency_days").alias("r1"), "rfm_segment", F.lit(1).alias("in_rfm"))
    c = churn_users(m, observation_date, threshold).select(
        USER, F.col("recency_days").alias("r2"), "churn_flag", F.lit(1).alias("in_churn"))
    both = r.join(c, USER, "outer")
    hv = F.col("rfm_segment") == HIGH_VALUE
    churned, kept = count_if(hv & (F.col("churn_flag") == 1)), count_if(hv & (F.col("churn_flag") == 0))
    return both.agg(
        count_if(F.col("in_rfm").isNotNull() & F.col("in_churn").isNotNull()).alias("matched_users"),
        count_if(F.col("in_churn").isNull()).alias("only_rfm_users"),
        count_if(F.col("in_rfm").isNull()).alias("only_churn_users"),
        count_if(F.col("r1") != F.col("r2")).alias("recency_mismatches"), count_if(hv).alias("high_value_users"),
        churned.alias("high_value_churn_users"), kept.alias("high_value_non_churn_users"),
        ratio(churned, count_if(hv)).alias("high_value_churn_rate"))


def user_value_base(m: Commerce, observation_date: str, threshold: int = THRESHOLD) -> DataFrame:
    """RFM scores, churn flag and representative geography per user. Churn follows from the
    recency the scores already hold, so the churn layer need not be joined."""
    hv = F.col("rfm_segment") == HIGH_VALUE
    churn = F.col("recency_days") > threshold
    return rfm_detail(m, observation_date).select(
        USER, "latest_order_id", "latest_order_purchase_timestamp", F.col("customer_state").alias("profile_state"),
        F.col("customer_city").alias("profile_city"), "recency_days", "frequency", "monetary", "r_score", "f_score",
        "m_score", "rfm_score", "rfm_code", "rfm_segment", "observation_date", flag(churn).alias("churn_flag"),
        flag(hv).alias("is_high_value_user"), flag(hv & churn).alias("is_high_value_churn_user"))


def user_value_report(m: Commerce, observation_date: str, threshold: int = THRESHOLD) -> DataFrame:
    return user_value_base(m, observation_date, threshold).withColumn("monetary", dbl("monetary"))


def high_value_users(m: Commerce, observation_date: str, threshold: int = THRESHOLD) -> DataFrame:
    """High-value users, each with the outcome of the two rule checks."""
    top = (F.col("r_score") >= 4) & (F.col("f_score") >= 4) & (F.col("m_score") >= 4)
    return user_value_report(m, observation_date, threshold).where("is_high_value_user = 1").select(
        "*", flag(top).alias("high_value_rule_ok"),
        flag((F.col("recency_days") > threshold) == (F.col("churn_flag") == 1)).alias("churn_rule_ok"))


def high_value_geography(m: Commerce, observation_date: str, by_city: bool = False) -> DataFrame:
    """All and high-value users and revenue per state (or city), in one grouping."""
    places = ["profile_state", "profile_city"] if by_city else ["profile_state"]
    hv = F.col("is_high_value_user") == 1
    t = user_value_base(m, observation_date).groupBy(*places).agg(
        F.count("*").alias("all_users"), F.sum("monetary").alias("all_user_gmv"), count_if(hv).alias("high_value_users"),
        sum_if(hv, "monetary").alias("high_value_gmv"), F.sum("is_high_value_churn_user").alias("high_value_churn_users"))
    a = W.partitionBy()  # one row per place
    share = lambda c: ratio(c, F.sum(c).over(a))
    return t.select(
        *places, "all_users", dbl("all_user_gmv").alias("all_user_gmv"), "high_value_users",
        dbl("high_value_gmv").alias("high_value_gmv"), "high_value_churn_users",
        share("all_users").alias("all_user_share"), share("high_value_users").alias("high_value_user_share"),
        ratio("high_value_users", "all_users").alias("high_value_penetration"),
        share("all_user_gmv").alias("all_gmv_share"), share("high_value_gmv").alias("high_value_gmv_share"),
        (share("high_value_users") - share("all_users")).alias("user_share_gap"))


# ------------------------------------------------------------ groups

def _flags(m: Commerce, observation_date: str) -> DataFrame:
    return user_value_base(m, observation_date).select(USER, "is_high_value_user")


def _unfold(cells: DataFrame) -> DataFrame:
    """Cells once per group they belong to: all users, and those of high value."""
    member = F.array_compact(F.array(F.lit(GROUPS[0]), F.when(F.col("is_high_value_user") == 1, GROUPS[1])))
    return cells.withColumn("group", F.explode(member))


def _grouped(cells: DataFrame, m: Commerce, observation_date: str) -> DataFrame:
    """User-level cells once per group the user belongs to. The cells are pre-aggregated, so the
    join meets at most a few rows per user and the explode copies no order rows."""
    return _unfold(cells.join(_flags(m, observation_date), USER))


def order_payments(m: Commerce) -> DataFrame:
    """Main type per order (largest amount, then name) with the representative record inside it
    (largest value, then sequence). Two nested aggregates, no window over an order."""
    inside = positive_payments(m).groupBy("order_id", "payment_type").agg(
        F.sum("payment_value").alias("amount"), F.count("*").alias("rows"),
        F.min_by(F.struct("payment_sequential", "payment_installments", "payment_value"),
                 F.struct((-F.col("payment_value")).alias("v"), "payment_sequential", "payment_installments")).alias("rep"))
    return inside.groupBy("order_id").agg(
        F.sum("amount").alias("amount"), F.sum("rows").alias("payment_record_count"),
        F.count("*").alias("payment_type_count"),
        F.min_by(F.struct("payment_type", "amount", "rows", "rep"),
                 F.struct((-F.col("amount")).alias("v"), "payment_type")).alias("main")).select(
        "order_id", "amount", "payment_record_count", "payment_type_count",
        F.col("main.payment_type").alias("main_payment_type"), F.col("main.amount").alias("main_payment_type_value"),
        F.col("main.rows").alias("main_payment_type_record_count"),
        F.col("main.rep.payment_sequential").alias("representative_payment_sequential"),
        F.col("main.rep.payment_installments").alias("main_payment_installments"),
        F.col("main.rep.payment_value").alias("representative_payment_value"))


def order_payment_base(m: Commerce, observation_date: str) -> DataFrame:
    i = F.col("main_payment_installments")
    kind = (F.when(i.isNull(), "no_positive_payment").when(i == 0, "zero_installment_flag")
            .when(i == 1, "one_time").when(i > 1, "installment").otherwise("unknown"))
    return (observed_orders(m, observation_date, payments=order_payments(m))
            .withColumn("installment_status", kind)
            .withColumn("is_mixed_payment_order", flag(F.col("payment_type_count") > 1)))


def order_payment_base_report(m: Commerce, observation_date: str) -> DataFrame:
    out = order_payment_base(m, observation_date).select(
        USER, "customer_id", "order_id", "order_purchase_timestamp", "customer_state", "customer_city", "order_gmv",
        "is_paid_order", "payment_record_count", "payment_type_count", "main_payment_type", "main_payment_type_value",
        "main_payment_type_record_count", "representative_payment_sequential", "main_payment_installments",
        "representative_payment_value", "installment_status", "is_mixed_payment_order")
    for c in ("order_gmv", "main_payment_type_value", "representative_payment_value"):
        out = out.withColumn(c, dbl(c))
    return out


def _payment_cells(m: Commerce, observation_date: str) -> DataFrame:
    return order_payment_base(m, observation_date).groupBy(
        USER, "is_paid_order", "main_payment_type", "main_payment_installments", "installment_status",
        "is_mixed_payment_order").agg(F.count("*").alias("orders"), F.sum("order_gmv").alias("gmv"))


def payment_behavior_groups(m: Commerce, observation_date: str) -> DataFrame:
    flags = _flags(m, observation_date)
    cells = (_payment_cells(m, observation_date).join(flags, USER).groupBy(
        "is_high_value_user", "is_paid_order", "main_payment_installments", "installment_status", "is_mixed_payment_order")
        .agg(F.sum("orders").alias("orders"), F.sum("gmv").alias("gmv")))
    g = _unfold(materialize(cells))  # a few hundred rows
    paid = F.col("is_paid_order") == 1
    n = lambda c: sum_if(c, "orders")
    kind = lambda k: n(paid & (F.col("installment_status") == k))
    i = F.col("main_payment_installments")
    # The flags have one row per user with an observed order.
    users = _unfold(flags.groupBy("is_high_value_user").agg(F.count("*").alias("n"))).groupBy("group").agg(
        F.sum("n").alias("users"))
    values = g.where(paid).groupBy("group", i).agg(F.sum("orders").alias("orders"))
    mid = values.groupBy("group").agg(
        ratio(F.sum(i * F.col("orders")), sum_if(i.isNotNull(), "orders")).alias("average_main_payment_installments"),
        F.percentile(i, F.lit(0.5), F.col("orders")).alias("median_main_payment_installments"))
    one, many = kind("one_time"), kind("installment")
    mixed = n(paid & (F.col("is_mixed_payment_order") == 1))
    stats = g.groupBy("group").agg(
        F.sum("orders").alias("orders"), n(paid).alias("paid_orders"), dbl(sum_if(paid, "gmv")).alias("gmv"),
        one.alias("one_time_orders"), many.alias("installment_orders"),
        ratio(one, one + many).alias("one_time_share_valid"), ratio(many, one + many).alias("installment_share_valid"),
        kind("zero_installment_flag").alias("zero_installment_orders"), mixed.alias("mixed_payment_orders"),
        ratio(mixed, n(paid)).alias("mixed_payment_share"))
    return stats.join(users, "group").join(mid, "group")


def payment_order_share_groups(m: Commerce, observation_date: str) -> DataFrame:
    g = _grouped(_payment_cells(m, observation_date).where("is_paid_order = 1"), m, observation_date)
    by = g.groupBy("group", "main_payment_type").agg(F.sum("orders").alias("orders"))
    return by.withColumn("order_share", ratio("orders", F.sum("orders").over(W.partitionBy("group"))))


def payment_gmv_share_groups(m: Commerce, observation_date: str) -> DataFrame:
    """Revenue by the type actually used, per group."""
    orders = observed_orders(m, observation_date).select("order_id", USER)
    split = positive_payments(m).groupBy("order_id", "payment_type").agg(F.sum("payment_value").alias("v"))
    cells = split.join(orders, "order_id").groupBy(USER, "payment_type").agg(F.sum("v").alias("v"))
    by = _grouped(cells, m, observation_date).groupBy("group", "payment_type").agg(F.sum("v").alias("gmv"))
    return by.select("group", "payment_type", dbl("gmv").alias("payment_gmv"),
                     ratio("gmv", F.sum("gmv").over(W.partitionBy("group"))).alias("gmv_share"))


def order_experience_base(m: Commerce, observation_date: str) -> DataFrame:
    return order_experience(m, observation_date).select(
        USER, "customer_id", "order_id", "order_purchase_timestamp", dbl("order_gmv").alias("order_gmv"), "is_paid_order",
        "order_delivered_customer_date", "order_estimated_delivery_date",
        F.col("review_id").alias("representative_review_id"), F.col("review_score").alias("representative_review_score"),
        F.col("review_creation_date").alias("representative_review_creation_date"),
        F.col("review_answer_timestamp").alias("representative_review_answer_timestamp"),
        flag(F.col("review_score").isNotNull()).alias("has_valid_review"),
        flag(F.col("delivery_micros").isNotNull()).alias("has_valid_delivery"),
        (F.col("delivery_micros") / 86_400_000_000.0).alias("delivery_days"),
        flag(F.col("is_delayed").isNotNull()).alias("has_valid_delay_measure"), "is_delayed")


def _experience_users(rows: DataFrame) -> DataFrame:
    score = F.col("review_score")
    return rows.groupBy(USER).agg(
        F.count("*").alias("orders"), F.count(score).alias("reviewed_orders"), F.sum(score).alias("points"),
        count_if(score == 1).alias("low_score_orders"), count_if(score >= 4).alias("positive_review_orders"),
        F.count("delivery_micros").alias("delivery_orders"),
        F.sum(F.col("delivery_micros").cast("decimal(20,0)")).alias("micros"),
        F.count("is_delayed").alias("delay_eligible_orders"),
        F.coalesce(F.sum("is_delayed"), F.lit(0)).alias("delayed_orders"))


def _days(micros, n):
    return ratio(micros, n) / 86_400_000_000.0


def experience_groups(m: Commerce, observation_date: str) -> DataFrame:
    g = _grouped(_experience_users(order_experience(m, observation_date)), m, observation_date)
    s = F.sum
    return g.groupBy("group").agg(
        F.count("*").alias("users"), s("orders").alias("orders"), s("reviewed_orders").alias("reviewed_orders"),
        (s("orders") - s("reviewed_orders")).alias("excluded_review_orders"),
        ratio(s("reviewed_orders"), s("orders")).alias("review_coverage"),
        ratio(s("points"), s("reviewed_orders")).alias("average_review_score"),
        s("low_score_orders").alias("low_score_orders"),
        ratio(s("low_score_orders"), s("reviewed_orders")).alias("low_score_order_share"),
        s("positive_review_orders").alias("positive_review_orders"),
        ratio(s("positive_review_orders"), s("reviewed_orders")).alias("positive_review_rate"),
        s("delivery_orders").alias("delivery_orders"), (s("orders") - s("delivery_orders")).alias("excluded_delivery_orders"),
        _days(s("micros"), s("delivery_orders")).alias("average_delivery_days"),
        s("delay_eligible_orders").alias("delay_eligible_orders"), s("delayed_orders").alias("delayed_orders"),
        ratio(s("delayed_orders"), s("delay_eligible_orders")).alias("delay_rate"))


# ------------------------------------------------------------ consumption

def consumption_groups(m: Commerce, observation_date: str, high_amount: float = HIGH_AMOUNT) -> DataFrame:
    paid = F.col("is_paid_order") == 1
    high = paid & (F.col("order_gmv") >= high_amount)
    users = observed_orders(m, observation_date).groupBy(USER).agg(
        F.count("*").alias("orders"), F.sum("is_paid_order").alias("paid"), F.sum("order_gmv").alias("gmv"),
        count_if(high).alias("high_orders"), sum_if(high, "order_gmv").alias("high_gmv"))
    g = _grouped(users, m, observation_date)
    s, n = F.sum, F.count("*")
    repeat = count_if(F.col("orders") >= 2)
    return g.groupBy("group").agg(
        n.alias("users"), s("orders").alias("valid_orders"), s("paid").alias("paid_orders"), dbl(s("gmv")).alias("gmv"),
        ratio(s("gmv"), n).alias("spend_per_user"), ratio(s("gmv"), s("paid")).alias("average_order_value"),
        ratio(s("orders"), n).alias("average_purchase_frequency"), repeat.alias("repeat_users"),
        ratio(repeat, n).alias("repeat_rate"), F.lit(float(high_amount)).alias("high_amount_threshold"),
        s("high_orders").alias("high_amount_orders"), ratio(s("high_orders"), s("paid")).alias("high_amount_order_share"),
        dbl(s("high_gmv")).alias("high_amount_gmv"), ratio(s("high_gmv"), s("gmv")).alias("high_amount_gmv_share"))


def _consumption_by(m: Commerce, observation_date: str, orders: DataFrame, dim: str) -> DataFrame:
    cells = orders.groupBy(USER, dim).agg(F.count("*").alias("orders"), F.sum("order_gmv").alias("gmv"))
    by = _grouped(cells, m, observation_date).groupBy("group", dim).agg(
        F.sum("orders").alias("orders"), F.sum("gmv").alias("gmv_total"))
    w = W.partitionBy("group")
    return by.select("group", dim, "orders", dbl("gmv_total").alias("gmv"),
                     ratio("orders", F.sum("orders").over(w)).alias("order_share"),
                     ratio("gmv_total", F.sum("gmv_total").over(w)).alias("gmv_share"))


def consumption_value_bands(m: Commerce, observation_date: str, bounds=(50, 100, 200, 500)) -> DataFrame:
    orders = observed_orders(m, observation_date).where("is_paid_order = 1").withColumn(
        "order_value_band", value_band("order_gmv", bounds))
    return _consumption_by(m, observation_date, orders, "order_value_band")


def consumption_hours(m: Commerce, observation_date: str) -> DataFrame:
    return _consumption_by(m, observation_date, observed_orders(m, observation_date), "purchase_hour").drop("gmv_share")


def consumption_day_type(m: Commerce, observation_date: str) -> DataFrame:
    """Weekday against weekend; the denominator is calendar days from the first order on."""
    orders = observed_orders(m, observation_date)
    first = scalar(orders.agg(F.min("purchase_date").alias("d")), "d")["d"]
    days = calendar_day_types(m.spark, first, F.lit(observation_date).cast("date"))
    by = _consumption_by(m, observation_date, orders.withColumn("day_type", day_type_column()), "day_type")
    return by.join(days.select(F.col("slot").alias("day_type"), F.col("calendar_day_count").alias("natural_days")),
                   "day_type").select("group", "day_type", "orders", "gmv", "natural_days",
                                      ratio("orders", "natural_days").alias("avg_daily_orders"), "order_share")


# ------------------------------------------------------------ lifecycle and profiles

def lifecycle_cross_detail(m: Commerce, observation_date: str) -> DataFrame:
    life = lifecycle_stage(m, observation_date).select(
        USER, "first_purchase_date", "last_purchase_date", F.col("valid_order_count").alias("lifecycle_valid_order_count"),
        F.col("lifetime_gmv").alias("lifecycle_gmv"), F.col("customer_lifecycle_days").alias("lifecycle_days"),
        F.col("recency_days").alias("lifecycle_recency_days"), "lifecycle_stage")
    return user_value_base(m, observation_date).join(life, USER, "left")


def lifecycle_cross_report(m: Commerce, observation_date: str) -> DataFrame:
    """The high-value users with their lifecycle fields."""
    return (lifecycle_cross_detail(m, observation_date).where("is_high_value_user = 1")
            .withColumn("monetary", dbl("monetary")).withColumn("lifecycle_gmv", dbl("lifecycle_gmv")))


def lifecycle_cross(m: Commerce, observation_date: str) -> DataFrame:
    """High-value users by lifecycle stage, with the mismatches between the two layers."""
    d = lifecycle_cross_detail(m, observation_date)
    differs = lambda c: flag(~F.coalesce(c, F.lit(False)))
    checked = (d.withColumn("frequency_bad", differs(F.col("frequency") == F.col("lifecycle_valid_order_count")))
               .withColumn("monetary_bad", differs(F.abs(F.col("monetary") - F.col("lifecycle_gmv")) <= 0.01))
               .withColumn("recency_bad", differs(F.col("recency_days") == F.col("lifecycle_recency_days")))
               .withColumn("dormant_bad", differs((F.col("churn_flag") == 1) == (F.col("lifecycle_stage") == DORMANT))))
    hv = F.col("is_high_value_user") == 1
    s = checked.groupBy("lifecycle_stage").agg(
        count_if(hv).alias("high_value_users"), F.sum("is_high_value_churn_user").alias("high_value_churn_users"),
        sum_if(hv, "frequency").alias("total_orders"), sum_if(hv, "monetary").alias("gmv_total"),
        ratio(sum_if(hv, "recency_days"), count_if(hv)).alias("avg_recency_days"),
        ratio(sum_if(hv, "lifecycle_days"), count_if(hv)).alias("avg_lifecycle_days"),
        *[F.sum(f"{k}_bad").alias(f"{k}_mismatches") for k in ("frequency", "monetary", "recency", "dormant")])
    return s.select(
        "lifecycle_stage", "high_value_users", "high_value_churn_users", "total_orders",
        dbl("gmv_total").alias("total_gmv"), "avg_recency_days", "avg_lifecycle_days",
        ratio("high_value_users", F.sum("high_value_users").over(W.partitionBy())).alias("high_value_user_share"),
        "frequency_mismatches", "monetary_mismatches", "recency_mismatches", "dormant_mismatches")


def _high_value_keys(m: Commerce, observation_date: str) -> DataFrame:
    return user_value_base(m, observation_date).where("is_high_value_user = 1").select(USER)


def payment_profile_user(m: Commerce, observation_date: str, keys: DataFrame | None = None) -> DataFrame:
    """Payment habits per high-value user; the dominant type is the one of most orders."""
    keys = _high_value_keys(m, observation_date) if keys is None else keys
    cells = _payment_cells(m, observation_date).join(keys, USER, "left_semi")
    paid = F.col("is_paid_order") == 1
    types = cells.where(paid).groupBy(USER, "main_payment_type").agg(F.sum("orders").alias("n"))
    main = types.groupBy(USER).agg(F.min_by(
        F.struct("main_payment_type", "n"), F.struct((-F.col("n")).alias("v"), "main_payment_type")).alias("d"))
    n = lambda c: sum_if(c, "orders")
    kind = lambda k: n(paid & (F.col("installment_status") == k))
    i, valid = F.col("main_payment_installments"), paid & (F.col("main_payment_installments") > 0)
    gmv = sum_if(paid, "gmv")
    users = cells.groupBy(USER).agg(
        n(paid).alias("paid_orders"), dbl(gmv).alias("payment_gmv"), ratio(gmv, n(paid)).alias("average_order_value"),
        ratio(F.sum(F.when(valid, i * F.col("orders"))), n(valid)).alias("avg_main_payment_installments_valid"),
        kind("one_time").alias("one_time_orders"), kind("installment").alias("installment_orders"),
        kind("zero_installment_flag").alias("zero_installment_orders"),
        n(paid & (F.col("is_mixed_payment_order") == 1)).alias("mixed_payment_orders"))
    return users.join(main, USER, "left").select(
        *users.columns, F.col("d.main_payment_type").alias("dominant_main_payment_type"),
        ratio(F.col("d.n"), "paid_orders").alias("dominant_payment_type_order_share"))


def experience_profile_user(m: Commerce, observation_date: str, keys: DataFrame | None = None) -> DataFrame:
    keys = _high_value_keys(m, observation_date) if keys is None else keys
    rows = order_experience(m, observation_date).join(keys, USER, "left_semi")
    return _experience_users(rows).select(
        USER, "reviewed_orders", ratio("points", "reviewed_orders").alias("average_review_score"), "low_score_orders",
        ratio("low_score_orders", "reviewed_orders").alias("low_score_order_share"),
        ratio("positive_review_orders", "reviewed_orders").alias("positive_review_rate"), "delivery_orders",
        _days("micros", "delivery_orders").alias("average_delivery_days"), "delay_eligible_orders", "delayed_orders",
        ratio("delayed_orders", "delay_eligible_orders").alias("delay_rate"))


def consumption_profile_user(m: Commerce, observation_date: str, high_amount: float = HIGH_AMOUNT,
                             keys: DataFrame | None = None) -> DataFrame:
    """Order habits per high-value user; the earliest hour wins among equally busy ones."""
    keys = _high_value_keys(m, observation_date) if keys is None else keys
    rows = observed_orders(m, observation_date).join(keys, USER, "left_semi")
    high = (F.col("is_paid_order") == 1) & (F.col("order_gmv") >= high_amount)
    hours = rows.groupBy(USER, "purchase_hour").agg(
        F.count("*").alias("n"), F.sum("is_paid_order").alias("paid"), count_if(high).alias("high"),
        count_if(F.col("weekday_number") <= 5).alias("weekday"))
    users = hours.groupBy(USER).agg(
        F.sum("n").alias("valid_orders"), F.sum("paid").alias("paid"), F.sum("high").alias("high_amount_orders"),
        F.sum("weekday").alias("weekday_orders"),
        F.min_by(F.struct("purchase_hour", "n"), F.struct((-F.col("n")).alias("v"), "purchase_hour")).alias("peak"))
    return users.select(
        USER, "valid_orders", F.lit(float(high_amount)).alias("high_amount_threshold"), "high_amount_orders",
        ratio("high_amount_orders", "paid").alias("high_amount_order_share"), "weekday_orders",
        (F.col("valid_orders") - F.col("weekday_orders")).alias("weekend_orders"),
        ratio("weekday_orders", "valid_orders").alias("weekday_order_share"),
        F.col("peak.purchase_hour").alias("peak_purchase_hour"), F.col("peak.n").alias("peak_hour_orders"))


def integrated_profile(m: Commerce, observation_date: str, high_amount: float = HIGH_AMOUNT) -> DataFrame:
    """All profiles of a high-value user side by side. Every input has one row per user; the tables behind them are
    held once."""
    m = m.held("orders", "customers", "payments", "reviews")
    users = materialize(user_value_base(m, observation_date).where("is_high_value_user = 1")
                        .withColumn("monetary", dbl("monetary")))
    keys = users.select(USER)
    life = lifecycle_stage(m, observation_date).select(
        USER, "lifecycle_stage", F.col("customer_lifecycle_days").alias("lifecycle_days"))
    parts = [life, payment_profile_user(m, observation_date, keys), experience_profile_user(m, observation_date, keys),
             consumption_profile_user(m, observation_date, high_amount, keys)]
    return reduce(lambda a, b: a.join(b, USER, "left"), parts, users)
