"""Delivery: time to arrival with open orders, its bearing on scores, and orders that are out of line for their lane."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallkeeper.functions import (MICROS_PER_DAY, QUARTILES, correlation, count_if, counted_ranks, dbl, flag, half_up,
                                   materialize, micros_between, nearest_rank, ratio, scalar, sum_if, top_row_per_key)
from stallkeeper.operators.cleaning import latest_review, sellable_items, valid_reviews
from stallkeeper.operators.metrics import delivered, order_paid
from stallkeeper.sources.model import Commerce

CLOSED = ("canceled", "unavailable")  # statuses that no longer wait for a delivery


# ---------------------------------------------------------------- time to delivery with open orders

def delivery_spells(m: Commerce, observation_date: str, closed: Sequence[str] = CLOSED) -> DataFrame:
    """One row per order bought by the end of the observation day: whole days until delivery (``arrived`` 1) or, for
    one still open, until that end (0). Orders that arrived later were open then. Closed orders wait for nothing; a
    delivery dated before the purchase, or none at all on a delivered order, cannot be timed: none of these has a row.
    """
    end = F.date_add(F.lit(observation_date).cast("date"), 1).cast("timestamp_ntz")
    bought, came = F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    arrived = came.isNotNull() & (came < end)
    lost = (came < bought) | (came.isNull() & delivered())
    orders = m.orders.where((bought < end) & ~F.col("order_status").isin(*closed) & ~F.coalesce(lost, F.lit(False)))
    span = micros_between(F.when(arrived, came).otherwise(end), bought)
    return orders.join(m.customers.select("customer_id", "customer_state"), "customer_id").select(
        "order_id", "customer_state", F.floor(span / MICROS_PER_DAY).cast("bigint").alias("day"), flag(arrived).alias("arrived"))


def survival(spells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Kaplan-Meier curve per group from (day, arrived): at_risk, arrivals and censored of each day, the share still
    open after it and its standard error (Greenwood). Of a day, arrivals come before censoring.

    Spells collapse to one row per group and day, so the ordered step sees as many rows as a history has days. A group
    without arrivals keeps a curve of 1; once all have arrived the curve is 0 with an error of 0.
    """
    by = list(by)
    days = spells.groupBy(*by, "day").agg(F.count(F.lit(1)).alias("n"), F.sum("arrived").alias("arrivals"))
    later = W.partitionBy(*by).orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = W.partitionBy(*by).orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = days.withColumn("at_risk", F.sum("n").over(later))
    d, r = dbl("arrivals"), dbl("at_risk")
    rows = (rows.withColumn("_log", F.sum(F.when(d < r, F.ln(1 - d / r)).otherwise(F.lit(0.0))).over(upto))
            .withColumn("_over", F.max(flag(d == r)).over(upto))
            .withColumn("_var", F.sum(F.when(d < r, d / (r * (r - d))).otherwise(F.lit(0.0))).over(upto)))
    open_ = F.when(F.col("_over") == 1, F.lit(0.0)).otherwise(F.exp("_log"))
    return rows.select(*by, "day", "at_risk", "arrivals", (F.col("n") - F.col("arrivals")).alias("censored"),
                       open_.alias("open_share"), (open_ * F.sqrt("_var")).alias("std_error"))


def delivery_survival(m: Commerce, observation_date: str) -> DataFrame:
    """The curve of all orders, on the days on which something arrived."""
    return survival(delivery_spells(m, observation_date)).where("arrivals > 0").select(
        "day", "at_risk", "arrivals", "censored", half_up("open_share", 8).alias("open_share"),
        half_up("std_error", 8).alias("std_error"))


def delivery_survival_by_state(m: Commerce, observation_date: str) -> DataFrame:
    """Per state: orders, how many arrived, the days until half and until nine tenths had arrived (NULL where the curve
    never falls that far), and what the mean of arrived orders alone would say."""
    spells = materialize(delivery_spells(m, observation_date))
    reached = lambda share: F.min(F.when(F.round("open_share", 9) <= share, F.col("day")))
    curve = survival(spells, ["customer_state"]).groupBy("customer_state").agg(
        F.sum("arrivals").alias("arrived_count"), F.sum("censored").alias("open_count"), reached(0.5).alias("median_days"),
        reached(0.1).alias("ninetieth_days"), F.sum(F.col("day") * F.col("arrivals")).alias("_days"),
        F.min("open_share").alias("_last"))
    return curve.select(
        "customer_state", (F.col("arrived_count") + F.col("open_count")).alias("order_count"), "arrived_count", "open_count",
        "median_days", "ninetieth_days", half_up(ratio("_days", "arrived_count"), 4).alias("mean_days_of_arrived"),
        half_up("_last", 6).alias("open_share_at_end"))


# ---------------------------------------------------------------- correlation with the score

MEASURES = ["dispatch", "transport", "delivery", "delay"]


def scored_spans(m: Commerce) -> DataFrame:
    """Delivered orders with a representative review, one row per measure: dispatch (purchase to carrier), transport
    (carrier to customer), delivery (purchase to customer) and delay (customer after estimate, negative if early).
    Spans that would be negative, but for the delay, cannot be right and are left out."""
    review = latest_review(valid_reviews(m)).select("order_id", "review_score")
    orders = m.orders.where(delivered()).join(review, "order_id")
    bought, sent, came, promised = (F.col(c) for c in (
        "order_purchase_timestamp", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"))
    spans = {"dispatch": (sent, bought), "transport": (came, sent), "delivery": (came, bought), "delay": (came, promised)}
    cells = F.array(*[F.struct(F.lit(n).alias("measure"), micros_between(*spans[n]).alias("micros")) for n in MEASURES])
    rows = orders.select("order_id", "review_score", F.explode(cells).alias("c")).select("order_id", "review_score", "c.*")
    return rows.where(F.col("micros").isNotNull() & ((F.col("micros") >= 0) | (F.col("measure") == "delay")))


def rank_correlation(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman's coefficient of two numeric columns per group; equal values share the mean of their places. Twice a
    rank less its mean is a whole number, so the sums are exact whatever the partitioning. NULL where one is constant.
    """
    by = list(by)
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = materialize(rows.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_k")))
    total = cells.groupBy(*by).agg(F.sum("_k").alias("_total"))
    ranked = cells
    for c in (x, y):
        ranks = counted_ranks(rows, c, by).select(*by, c, F.col("average_rank").alias(f"_{c}"))
        ranked = ranked.join(ranks, [*by, c])
    ranked = ranked.join(total, by) if by else ranked.withColumn("_total", scalar(total, "_total")["_total"])
    off = lambda c: (2 * F.col(f"_{c}") - F.col("_total") - 1).cast("decimal(19,0)")
    part = lambda a, b: dbl(F.sum((off(a) * off(b)).cast("decimal(38,0)") * F.col("_k").cast("decimal(10,0)")))
    sums = ranked.groupBy(*by).agg(part(x, y).alias("_xy"), part(x, x).alias("_xx"), part(y, y).alias("_yy"), F.sum("_k").alias("n"))
    return sums.select(*by, "n", F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy")).alias("rank_correlation"))


def logistics_correlation(m: Commerce) -> DataFrame:
    """Per measure: Pearson's and Spearman's coefficient of days and score, and the line score = intercept + slope days."""
    rows = materialize(scored_spans(m).withColumn("days", F.col("micros") / MICROS_PER_DAY))
    score, days = dbl("review_score"), F.col("days")
    moments = rows.groupBy("measure").agg(
        correlation("days", score).alias("pearson"), F.regr_slope(score, days).alias("slope"),
        F.regr_intercept(score, days).alias("intercept"), F.avg("days").alias("mean_days"), F.avg(score).alias("mean_score"))
    ranks = rank_correlation(rows, "micros", "review_score", ["measure"])
    return moments.join(ranks, "measure").select(
        "measure", F.col("n").alias("order_count"), half_up("mean_days", 4).alias("mean_days"),
        half_up("mean_score", 4).alias("mean_score"), half_up("pearson", 8).alias("pearson"),
        half_up("rank_correlation", 8).alias("spearman"), half_up("slope", 8).alias("score_per_day"),
        half_up("intercept", 6).alias("intercept"))


# ---------------------------------------------------------------- orders out of line

POOL = "*"


def lane_spans(m: Commerce, least_orders: int = 30) -> DataFrame:
    """Delivered orders with dispatch and transport span and their lane: state of the seller with the most item value
    (ties: smallest id) to the customer's state. Lanes with few orders are pooled in one."""
    value = sellable_items(m).groupBy("order_id", "seller_id").agg(F.sum("price").alias("price"))
    main = top_row_per_key(value, ["order_id"], [F.desc("price"), F.col("seller_id")]).join(
        m.sellers.select("seller_id", F.col("seller_state").alias("origin")), "seller_id").select("order_id", "origin")
    bought, sent, came = (F.col(c) for c in (
        "order_purchase_timestamp", "order_delivered_carrier_date", "order_delivered_customer_date"))
    rows = (m.orders.where(delivered() & (sent >= bought) & (came >= sent)).join(main, "order_id")
            .join(m.customers.select("customer_id", F.col("customer_state").alias("destination")), "customer_id")
            .select("order_id", "origin", "destination", micros_between(sent, bought).alias("dispatch"),
                    micros_between(came, sent).alias("transport"),
                    F.coalesce(flag(came > F.col("order_estimated_delivery_date")), F.lit(0)).alias("is_late")))
    rows = materialize(rows)
    busy = rows.groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("_n"))
    pooled = F.col("_n") < least_orders
    return rows.join(busy, ["origin", "destination"]).withColumn("lane", F.when(pooled, POOL).otherwise(
        F.concat_ws(">", "origin", "destination"))).drop("_n")


def robust_scores(rows: DataFrame, lane: str, spans: Sequence[str], least_scale: float) -> DataFrame:
    """Adds ``<span>_z``: distance from the lane's median in units of 1.4826 times its median absolute deviation (or of
    ``least_scale``, where that is more). Medians are nearest ranks, found without ordering a lane in one task."""
    long = rows.select(lane, F.explode(F.array(*[F.struct(F.lit(s).alias("field"), dbl(s).alias("v")) for s in spans])).alias("c"))
    long = materialize(long.select(lane, "c.field", "c.v"))
    half = {"median": QUARTILES["median"]}
    middle = materialize(nearest_rank(long, "v", half, [lane, "field"]).select(lane, "field", "median"))
    off = long.join(middle, [lane, "field"]).select(lane, "field", F.abs(F.col("v") - F.col("median")).alias("v"))
    spread = nearest_rank(off, "v", half, [lane, "field"]).select(lane, "field", F.col("median").alias("mad"))
    at = lambda s, c: F.max(F.when(F.col("field") == s, F.col(c)))
    wide = middle.join(spread, [lane, "field"]).groupBy(lane).agg(*[
        at(s, c).alias(f"_{s}_{c}") for s in spans for c in ("median", "mad")])
    scaled = lambda s: F.greatest(F.lit(1.4826) * F.col(f"_{s}_mad"), F.lit(float(least_scale)))
    return rows.join(wide, lane).select(*rows.columns, *[
        ((dbl(s) - F.col(f"_{s}_median")) / scaled(s)).alias(f"{s}_z") for s in spans])


def abnormal_scores(m: Commerce, threshold: float = 9.21, cut: float = 3.0, least_orders: int = 30,
                    least_scale_hours: float = 1.0) -> DataFrame:
    """Every timed order with its robust scores and the squared distance of both at once.

    The distance allows for the correlation of the two scores, taken from orders within ``cut`` on both. Beyond
    ``threshold`` (9.21: one in a hundred of a normal pair) and slow on a side the order is abnormal; the cause is the
    span beyond ``cut``, both if both are, and the larger one if neither is."""
    rows = materialize(robust_scores(lane_spans(m, least_orders), "lane", ["dispatch", "transport"],
                                     least_scale_hours * MICROS_PER_DAY / 24))
    a, b = F.col("dispatch_z"), F.col("transport_z")
    inner = rows.where((F.abs(a) <= cut) & (F.abs(b) <= cut))
    rho = F.coalesce(scalar(inner.agg(correlation("dispatch_z", "transport_z").alias("r")), "r")["r"], F.lit(0.0))
    # Scores on one line leave no second direction to measure; they are then taken one by one.
    rows = rows.withColumn("_r", F.when(F.abs(rho) > 0.999, F.lit(0.0)).otherwise(rho))
    distance = (a * a - 2 * F.col("_r") * a * b + b * b) / (1 - F.col("_r") * F.col("_r"))
    cause = (F.when((a > cut) & (b > cut), "both").when((a > cut) | ((b <= cut) & (a >= b)), "late dispatch")
             .otherwise("late transport"))
    odd = (F.col("distance") > threshold) & ((a > 0) | (b > 0))
    return rows.withColumn("distance", distance).withColumn("cause", F.when(odd, cause)).drop("_r")


def abnormal_orders(m: Commerce, **how: float) -> DataFrame:
    rows = abnormal_scores(m, **how).where(F.col("cause").isNotNull())
    days = lambda c: half_up(F.col(c) / MICROS_PER_DAY, 6).alias(f"{c}_days")
    return rows.select("order_id", "origin", "destination", "lane", days("dispatch"), days("transport"),
                       *[half_up(c, 6).alias(c) for c in ("dispatch_z", "transport_z", "distance")], "cause", "is_late")


def abnormal_order_summary(m: Commerce, **how: float) -> DataFrame:
    """Per destination: how many orders are abnormal and why, the revenue they carry, and the scores they got."""
    review = latest_review(valid_reviews(m)).select("order_id", "review_score")
    rows = abnormal_scores(m, **how).join(order_paid(m), "order_id", "left").join(review, "order_id", "left")
    odd = F.col("cause").isNotNull()
    because = lambda c: count_if(F.col("cause") == c)
    mean = lambda cond: half_up(ratio(F.sum(F.when(cond, F.col("review_score"))), count_if(
        cond & F.col("review_score").isNotNull())), 4)
    out = rows.groupBy("destination").agg(
        F.count(F.lit(1)).alias("order_count"), count_if(odd).alias("abnormal_count"),
        because("late dispatch").alias("late_dispatch_count"), because("late transport").alias("late_transport_count"),
        because("both").alias("both_count"), F.sum("is_late").alias("late_count"),
        count_if(odd & (F.col("is_late") == 1)).alias("late_abnormal_count"),
        dbl(sum_if(odd, "amount")).alias("abnormal_gmv"), dbl(F.coalesce(F.sum("amount"), F.lit(0))).alias("gmv"),
        mean(odd).alias("abnormal_score"), mean(~odd).alias("other_score"))
    return out.select(
        F.col("destination").alias("customer_state"), "order_count", "abnormal_count",
        half_up(ratio("abnormal_count", "order_count"), 6).alias("abnormal_share"), "late_dispatch_count",
        "late_transport_count", "both_count", "late_count", "late_abnormal_count", "abnormal_gmv",
        half_up(ratio("abnormal_gmv", "gmv"), 6).alias("abnormal_gmv_share"), "abnormal_score", "other_score")
