"""Monthly and daily KPI series, filtered KPIs and holiday windows."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window as W, functions as F

from stallkeeper.functions import (half_up, calendar, count_if, dbl, literal_rows, month_index, month_of, ratio)
from stallkeeper.operators.metrics import order_paid
from stallkeeper.sources.model import Commerce

METRICS = ["gmv", "order_count", "average_order_value", "new_users", "active_users"]


def paid_user_orders(m: Commerce) -> DataFrame:
    """Delivered orders with positive payment and their user."""
    ts = F.col("order_purchase_timestamp")
    orders = m.orders_core.where((F.col("order_status") == "delivered") & ts.isNotNull()
                                 & F.col("order_estimated_delivery_date").isNotNull())
    return (orders.join(order_paid(m), "order_id")
            .join(m.customers.select("customer_id", "customer_unique_id", "customer_state"), "customer_id")
            .where(F.col("customer_unique_id").isNotNull())
            .select("order_id", "customer_unique_id", "customer_state", ts, month_of(ts).alias("month"), "amount"))


def _period_kpi(orders: DataFrame, by: list[str], period: str) -> DataFrame:
    """KPI per period from one user-period aggregate: its row count gives the active users,
    its earliest period per user the new ones. A user contributes one row per period to the
    window, however many orders the user placed."""
    user = orders.groupBy(*by, "customer_unique_id", period).agg(
        F.sum("amount").alias("gmv"), F.count("*").alias("orders"))
    first = F.min(period).over(W.partitionBy(*by, "customer_unique_id"))
    return (user.withColumn("first", first).groupBy(*by, period).agg(
        dbl(F.sum("gmv")).alias("gmv"), F.sum("orders").alias("order_count"),
        ratio(F.sum("gmv"), F.sum("orders")).alias("average_order_value"),
        count_if(F.col("first") == F.col(period)).alias("new_users"), F.count("*").alias("active_users")))


def monthly_kpi(m: Commerce) -> DataFrame:
    return _period_kpi(paid_user_orders(m), [], "month")


def monthly_kpi_by_state(m: Commerce) -> DataFrame:
    return _period_kpi(paid_user_orders(m), ["customer_state"], "month")


def daily_kpi(m: Commerce) -> DataFrame:
    days = paid_user_orders(m).withColumn("order_date", F.to_date("order_purchase_timestamp"))
    return _period_kpi(days, [], "order_date").select(
        "order_date", "gmv", "order_count", half_up("average_order_value", 2).alias("average_order_value"),
        "new_users", F.col("active_users").alias("active_users_per_day"))


def fill_months(kpi: DataFrame) -> DataFrame:
    """Add the months missing between observed ones, with NULL metrics. Works on one row per
    month and needs no join: each row stands in for the gap that follows it."""
    at = month_index("month")
    following = F.lead(at).over(W.partitionBy().orderBy("month"))
    spread = kpi.withColumn("_gap", (F.coalesce(following, at + 1) - at - 1).cast("int")).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.col("_gap"))))
    metrics = [c for c in kpi.columns if c != "month"]
    day = F.add_months(F.to_date(F.concat("month", F.lit("-01"))), F.col("_k"))
    return spread.select(F.date_format(day, "yyyy-MM").alias("month"),
                         *[F.when(F.col("_k") == 0, F.col(c)).alias(c) for c in metrics])


# ------------------------------------------------------------ filters

@dataclass(frozen=True)
class Filters:
    """Selection of paid delivered orders; an empty list means no restriction."""
    first_day: str
    last_day: str
    states: list[str] = field(default_factory=list)
    payments: list[str] = field(default_factory=list)
    bands: list[str] = field(default_factory=list)


def select_orders(m: Commerce, f: Filters, bounds: tuple[float, ...] = (50, 100, 200, 500)) -> DataFrame:
    """Orders meeting the filters. A payment filter keeps the whole of any order that used one
    of the types, so amounts are never cut."""
    from stallkeeper.operators.cleaning import positive_payments
    from stallkeeper.operators.structure import value_band
    day = F.to_date("order_purchase_timestamp")
    out = paid_user_orders(m).where(day.between(F.lit(f.first_day).cast("date"), F.lit(f.last_day).cast("date")))
    if f.states:
        out = out.where(F.col("customer_state").isin(*f.states))
    if f.bands:
        out = out.where(value_band("amount", bounds).isin(*f.bands))
    if f.payments:
        used = positive_payments(m).where(F.col("payment_type").isin(*f.payments)).select("order_id")
        out = out.join(used, "order_id", "left_semi")
    return out


def _with_first(m: Commerce, orders: DataFrame) -> DataFrame:
    first = paid_user_orders(m).groupBy("customer_unique_id").agg(
        F.min("order_purchase_timestamp").alias("first_paid"))
    return orders.join(first, "customer_unique_id").withColumn(
        "is_first", F.col("order_purchase_timestamp") == F.col("first_paid"))


def kpi_filtered(m: Commerce, f: Filters, bounds=(50, 100, 200, 500)) -> DataFrame:
    users = _with_first(m, select_orders(m, f, bounds)).groupBy("customer_unique_id").agg(
        F.sum("amount").alias("gmv"), F.count("*").alias("orders"), F.max("is_first").alias("is_new"))
    return users.agg(
        dbl(F.coalesce(F.sum("gmv"), F.lit(0))).alias("gmv"), F.coalesce(F.sum("orders"), F.lit(0)).alias("order_count"),
        F.coalesce(ratio(F.sum("gmv"), F.sum("orders")), F.lit(0.0)).alias("average_order_value"),
        count_if(F.col("is_new")).alias("new_users"), F.count("*").alias("active_users"))


def kpi_monthly_trend(m: Commerce, f: Filters, bounds=(50, 100, 200, 500)) -> DataFrame:
    """Complete monthly series of the selection: 0 in a month the source covers, NULL in one
    it does not."""
    user = _with_first(m, select_orders(m, f, bounds)).groupBy("month", "customer_unique_id").agg(
        F.sum("amount").alias("gmv"), F.count("*").alias("orders"), F.max("is_first").alias("is_new"))
    series = user.groupBy("month").agg(
        dbl(F.sum("gmv")).alias("gmv"), F.sum("orders").alias("order_count"),
        count_if(F.col("is_new")).alias("new_users"), F.count("*").alias("active_users"))
    months = calendar(m.spark, F.trunc(F.lit(f.first_day).cast("date"), "month"),
                      F.trunc(F.lit(f.last_day).cast("date"), "month"), "month", "d").select(
        F.date_format("d", "yyyy-MM").alias("month"))
    covered = paid_user_orders(m).select("month").distinct().withColumn("covered", F.lit(True))
    fill = lambda c: F.when(F.col("covered"), F.coalesce(F.col(c), F.lit(0))).alias(c)
    return (months.join(covered, "month", "left").join(series, "month", "left")
            .select("month", fill("gmv"), fill("order_count"), fill("new_users"), fill("active_users"))
            .withColumn("average_order_value", ratio("gmv", "order_count")))


# ------------------------------------------------------------ holidays

def holiday_windows(m: Commerce, holidays: list[tuple], window_days: int = 7) -> DataFrame:
    """Seven days before, during and seven days after each holiday: coverage, totals, daily
    averages and, where both windows are complete, the change against the days before.

    ``holidays`` holds (name, year, first day, last day). Each window is expanded to its days
    and matched on equality, so no range join is needed."""
    h = literal_rows(m.spark, "holiday_name string, year bigint, first date, last date", holidays)
    window = lambda kind, a, b: F.struct(F.lit(kind).alias("period_type"), a.alias("start_date"), b.alias("end_date"))
    windows = h.select("holiday_name", "year", F.explode(F.array(
        window("PRE", F.date_sub("first", window_days), F.date_sub("first", 1)),
        window("DURING", F.col("first"), F.col("last")),
        window("POST", F.date_add("last", 1), F.date_add("last", window_days)))).alias("w")).select(
        "holiday_name", "year", "w.*")
    keys = ["holiday_name", "year", "period_type", "start_date", "end_date"]
    days = windows.withColumn("order_date", F.explode(F.sequence("start_date", "end_date")))
    daily = daily_kpi(m).select("order_date", "gmv", "order_count")
    stats = days.join(daily, "order_date", "left").groupBy(*keys).agg(
        F.count("*").alias("expected_day_count"), F.count("gmv").alias("observed_day_count"),
        F.coalesce(F.sum(F.col("gmv").cast("decimal(28,2)")), F.lit(0)).cast("double").alias("gmv_observed"),
        F.coalesce(F.sum("order_count"), F.lit(0)).alias("order_count_observed"))
    stats = (stats.withColumn("aov", ratio("gmv_observed", "order_count_observed"))
             .withColumn("daily_gmv", ratio("gmv_observed", "observed_day_count"))
             .withColumn("daily_orders", ratio("order_count_observed", "observed_day_count"))
             .withColumn("complete", F.col("observed_day_count") == F.col("expected_day_count")))
    w = W.partitionBy("holiday_name", "year")
    values = {"gmv_change_vs_pre": "gmv_observed", "order_change_vs_pre": "order_count_observed",
              "aov_change_vs_pre": "aov", "daily_gmv_change_vs_pre": "daily_gmv",
              "daily_orders_change_vs_pre": "daily_orders"}
    is_pre = F.col("period_type") == "PRE"
    before = lambda c: F.max(F.when(is_pre, F.col(c))).over(w)
    formal = ~is_pre & F.col("complete") & before("complete")
    # Status and note texts.
    status = (F.when(is_pre & F.col("complete"), "Complete baseline").when(is_pre, "Incomplete baseline")
              .when(formal, "Validated").otherwise("Observed-only; formal comparison unavailable"))
    note = (F.when(F.col("complete"), "Complete").when(F.col("observed_day_count") == 0, "No observed dates")
            .otherwise(F.concat(F.lit("Partial coverage: "), F.col("observed_day_count"), F.lit("/"),
                                F.col("expected_day_count"), F.lit(" expected dates observed"))))
    return stats.select(
        *keys, "expected_day_count", "observed_day_count",
        half_up(ratio("observed_day_count", "expected_day_count"), 6).alias("coverage_rate"),
        "gmv_observed", "order_count_observed", half_up("aov", 2).alias("average_order_value_observed"),
        half_up("daily_gmv", 2).alias("daily_average_gmv_observed"),
        half_up("daily_orders", 6).alias("daily_average_orders_observed"),
        *[F.when(formal, half_up(ratio(v, before(v)) - 1, 6)).alias(k) for k, v in values.items()],
        status.alias("comparison_status"), note.alias("data_completeness_note"))


def holiday_observed_change(m: Commerce, holidays: list[tuple]) -> DataFrame:
    """The formal change where it exists, else the change between observed values, marked so."""
    rows = holiday_windows(m, holidays)
    metrics = {"daily_gmv": ("daily_average_gmv_observed", "daily_gmv_change_vs_pre"),
               "daily_orders": ("daily_average_orders_observed", "daily_orders_change_vs_pre"),
               "average_order_value": ("average_order_value_observed", "aov_change_vs_pre")}
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(v).alias("value"), F.col(c).alias("formal"))
                                for n, (v, c) in metrics.items()]))
    long = rows.select("holiday_name", "year", "period_type", cells.alias("c")).select(
        "holiday_name", "year", "period_type", "c.*")
    w = W.partitionBy("holiday_name", "year", "metric")
    pre = F.max(F.when(F.col("period_type") == "PRE", F.col("value"))).over(w)
    return (long.withColumn("observed", ratio("value", pre) - 1).where("period_type <> 'PRE'").select(
        "holiday_name", "year", "period_type", "metric",
        F.coalesce("formal", half_up("observed", 6)).alias("change_vs_pre"),
        (F.col("formal").isNull() & F.col("observed").isNotNull()).cast("bigint").alias("is_observed_only")))


def holiday_month_compare(m: Commerce, holiday_months: list[str], excluded: list[str] | None = None) -> DataFrame:
    """Holiday months against the mean of all other months (excluded months left out)."""
    kpi = monthly_kpi(m)
    if excluded:
        kpi = kpi.where(~F.col("month").isin(*excluded))
    special = F.col("month").isin(*holiday_months)
    everything = W.partitionBy()  # one row per month
    other = lambda c: half_up(F.avg(F.when(~special, F.col(c))).over(everything), 2)
    return kpi.select(
        F.col("month").alias("holiday_month"), "gmv", "order_count",
        half_up("average_order_value", 2).alias("average_order_value"),
        other("gmv").alias("avg_gmv_other_months"), other("order_count").alias("avg_order_count_other_months"),
        other("average_order_value").alias("avg_aov_other_months"), special.alias("s")).where("s").drop("s")
