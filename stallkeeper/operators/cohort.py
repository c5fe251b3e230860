"""Cohort retention, short-term repeat purchase and lifecycle stages."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from stallkeeper.functions import (MICROS_PER_DAY, count_if, dbl, half_up, materialize, micros_between,
                                   month_index, ratio, scalar)
from stallkeeper.operators.customers import customer_order_base, customer_profile, observed_orders
from stallkeeper.operators.metrics import cohort_counts
from stallkeeper.sources.model import Commerce

WINDOWS = (7, 30, 90)
# Lifecycle stage names.
DORMANT, NEW, EARLY, GROWING, MATURE = (
    "Dormant Customer", "New Customer", "Early Customer", "Growing Customer", "Mature Customer")


def cohort_monthly(m: Commerce) -> DataFrame:
    """Observed cohort by activity month of paid orders (no rows for empty months)."""
    active = customer_order_base(m).where("is_paid_order = 1").select(
        "customer_unique_id", F.col("purchase_month").alias("month")).distinct()
    return cohort_counts(active).select(
        "cohort_month", F.col("month").alias("active_month"),
        (month_index("month") - month_index("cohort_month")).alias("cohort_index"), "initial_users", "active_users",
        half_up(ratio("active_users", "initial_users"), 4).alias("retention_rate"))


def cohort_matrix(m: Commerce, months: int | None = None) -> DataFrame:
    """Cohort by month index. The columns follow the history, found in the stored series of months;
    ``months`` fixes their number instead, for a caller that knows it."""
    series = cohort_monthly(m)
    rates = (series if months is not None else materialize(series)).groupBy("cohort_month")
    wide = rates.pivot("cohort_index") if months is None else rates.pivot("cohort_index", list(range(months)))
    return wide.agg(F.max("retention_rate"))


def _first_two(m: Commerce, end: str) -> DataFrame:
    """First and second paid order time per user up to the end of observation. The ranking is
    limited to two rows per user before the shuffle."""
    ts = F.col("order_purchase_timestamp")
    w = W.partitionBy("customer_unique_id").orderBy(ts, "order_id")
    return (customer_order_base(m).where((F.col("is_paid_order") == 1) & (ts <= F.lit(end).cast("timestamp_ntz")))
            .select("customer_unique_id", ts, "order_id").withColumn("rn", F.row_number().over(w)).where("rn <= 2")
            .groupBy("customer_unique_id").agg(
                F.max(F.when(F.col("rn") == 1, ts)).alias("first_time"),
                F.max(F.when(F.col("rn") == 2, ts)).alias("second_time")))


def _eligible(end: str, days: int):
    """The whole window of ``days`` x 24 hours lies inside the observation."""
    return F.col("first_time") <= F.lit(end).cast("timestamp_ntz") - F.expr(f"interval {days} days")


def short_term_repeat(m: Commerce, end: str, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Share of users whose second order follows the first within 7, 30 and 90 times 24 hours.
    Only users with a full window count, above and below the line."""
    gap = micros_between("second_time", "first_time")
    out = [F.count("*").alias("total_users")]
    for d in windows:
        seen = count_if(_eligible(end, d))
        hit = count_if(_eligible(end, d) & (gap > 0) & (gap <= int(d * MICROS_PER_DAY)))
        out += [seen.alias(f"obs_{d}d"), (F.count("*") - seen).alias(f"excluded_{d}d"), hit.alias(f"repeat_{d}d"),
                half_up(ratio(hit, seen), 4).alias(f"repeat_rate_{d}d")]
    return _first_two(m, end).agg(*out)


def observation_windows(m: Commerce, end: str, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Latest first purchase that still has a full window, with users kept and left out."""
    cells = F.array(*[F.struct(F.lit(f"{d}d").alias("window"), F.lit(d).cast("bigint").alias("window_days"),
                               _eligible(end, d).alias("ok")) for d in windows])
    per = (_first_two(m, end).select(F.explode(cells).alias("c")).groupBy("c.window", "c.window_days").agg(
        count_if(F.col("c.ok")).alias("eligible_users"), count_if(~F.col("c.ok")).alias("excluded_users")))
    stop = F.lit(end).cast("timestamp_ntz")
    return per.select("window", stop.alias("observation_end"),
                      (stop - F.make_dt_interval(F.col("window_days").cast("int"))).alias("latest_eligible_first_purchase"),
                      "window_days", "eligible_users", "excluded_users")


# ------------------------------------------------------------ lifecycle

DORMANT_AFTER, NEW_UNTIL, GROWING_UNTIL = 90, 30, 180  # days


def stage(recency, orders, lifetime, dormant_after: int = DORMANT_AFTER, new_until: int = NEW_UNTIL,
          growing_until: int = GROWING_UNTIL):
    """Exclusive stages; dormancy is tested first."""
    return (F.when(recency > dormant_after, DORMANT).when((orders == 1) & (recency <= new_until), NEW)
            .when(orders == 1, EARLY).when((orders >= 2) & (lifetime <= growing_until), GROWING).when(orders >= 2, MATURE).otherwise("UNCLASSIFIED"))


def lifecycle_stage(m: Commerce, observation_date: str, **limits: int) -> DataFrame:
    """Official stages: orders up to the observation date, whole days."""
    users = observed_orders(m, observation_date).groupBy("customer_unique_id").agg(
        F.min("purchase_date").alias("first_purchase_date"), F.max("purchase_date").alias("last_purchase_date"),
        F.count("*").alias("valid_order_count"), F.sum("order_gmv").alias("lifetime_gmv"))
    when = F.lit(observation_date).cast("date")
    return (users.withColumn("customer_lifecycle_days",
                             F.date_diff("last_purchase_date", "first_purchase_date").cast("bigint"))
            .withColumn("recency_days", F.date_diff(when, F.col("last_purchase_date")).cast("bigint"))
            .withColumn("lifecycle_stage", stage(F.col("recency_days"), F.col("valid_order_count"),
                                                 F.col("customer_lifecycle_days"), **limits))
            .withColumn("observation_date", F.lit(observation_date)))


def lifecycle_stage_report(m: Commerce, observation_date: str) -> DataFrame:
    return lifecycle_stage(m, observation_date).withColumn("lifetime_gmv", dbl("lifetime_gmv"))


def lifecycle_stage_by_latest(m: Commerce) -> DataFrame:
    """The other definition: whole history, measured in fractional days from the latest order."""
    p = customer_profile(m)
    latest = scalar(p.agg(F.max("last_purchase_timestamp").alias("t")), "t")["t"]
    recency = micros_between("cutoff", "last_purchase_timestamp") / MICROS_PER_DAY
    return p.withColumn("cutoff", latest).withColumn("recency_days", recency).select(
        "customer_unique_id",
        stage(F.col("recency_days"), F.col("valid_order_count"), F.col("customer_lifecycle_days")).alias("lifecycle_stage"),
        "valid_order_count", "customer_lifecycle_days", "recency_days")


def lifecycle_comparison(m: Commerce, observation_date: str) -> DataFrame:
    users = lifecycle_stage(m, observation_date)
    total = F.sum("user_count").over(W.partitionBy())  # one row per stage
    orders, gmv, n = F.sum("valid_order_count"), F.sum("lifetime_gmv"), F.count("*")
    repeat = count_if(F.col("valid_order_count") >= 2)
    by = users.groupBy("lifecycle_stage").agg(
        n.alias("user_count"), orders.alias("order_count"), half_up(gmv, 2).alias("gmv"),
        half_up(ratio(gmv, n), 2).alias("avg_customer_spend"), half_up(ratio(gmv, orders), 2).alias("gmv_per_valid_order"),
        half_up(ratio(orders, n), 2).alias("avg_purchase_frequency"), repeat.alias("repeat_users"),
        half_up(ratio(repeat, n), 4).alias("repeat_rate"),
        half_up(ratio(F.sum("customer_lifecycle_days"), n), 2).alias("avg_lifecycle_days"),
        half_up(ratio(F.sum("recency_days"), n), 2).alias("avg_recency_days"))
    return by.withColumn("user_percentage", half_up(ratio("user_count", total), 4))


def lifecycle_diff(m: Commerce, observation_date: str) -> DataFrame:
    """Users by official and other stage, by whole-day recency difference, and by mismatch."""
    a = lifecycle_stage(m, observation_date).select(
        "customer_unique_id", F.col("lifecycle_stage").alias("official_stage"), F.col("valid_order_count").alias("n1"),
        F.col("customer_lifecycle_days").alias("d1"), F.col("recency_days").alias("r1"))
    b = lifecycle_stage_by_latest(m).select(
        "customer_unique_id", F.col("lifecycle_stage").alias("other_stage"), F.col("valid_order_count").alias("n2"),
        F.floor("customer_lifecycle_days").alias("d2"), F.floor("recency_days").alias("r2"))
    both = a.join(b, "customer_unique_id", "left")
    none = F.lit(None).cast("string")
    cell = lambda name, x, y: F.struct(
        F.lit(name).alias("section"), x.alias("official"), y.cast("string").alias("other"))
    cells = F.array(
        cell("stage_crosstab", F.col("official_stage"), F.col("other_stage")),
        cell("recency_diff", none, F.col("r2") - F.col("r1")),
        cell("order_count_differs", none, F.col("n1") != F.col("n2")),
        cell("lifecycle_days_differ", none, F.col("d1") != F.col("d2")))
    return both.select(F.explode(cells).alias("c")).groupBy("c.section", "c.official", "c.other").agg(
        F.count("*").alias("user_count"))
