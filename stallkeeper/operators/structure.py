"""Payment, order-value and regional structure of paid delivered orders."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from stallkeeper.functions import half_up, count_if, dbl, flag, literal_rows, materialize, month_of, ratio, with_values
from stallkeeper.operators import cleaning as C
from stallkeeper.sources.model import Commerce

BOUNDS = (50, 100, 200, 500)
PERIODS = [("2017-01_to_2017-07", "2017-01", "2017-07"), ("2018-01_to_2018-07", "2018-01", "2018-07")]
ALL = "ALL_DATA"


def band_names(bounds: Sequence[float] = BOUNDS) -> list[str]:
    edges = [0, *bounds]
    return [f"{a}-{b}" for a, b in zip(edges, edges[1:])] + [f"{edges[-1]}+"]


def value_band(amount, bounds: Sequence[float] = BOUNDS):
    """Band of an amount; an amount on an edge belongs to the upper band."""
    a = F.col(amount) if isinstance(amount, str) else amount
    names = band_names(bounds)
    out = F.when(a < 0, None)
    for edge, name in zip(bounds, names):
        out = out.when(a < edge, name)
    return out.when(a >= bounds[-1], names[-1])


def _period_column(month, periods):
    out = None
    for name, first, last in periods:
        hit = month.between(first, last)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def order_type_amounts(m: Commerce) -> DataFrame:
    """Order by payment type: the grain every payment view starts from."""
    return C.positive_payments(m).groupBy("order_id", "payment_type").agg(
        F.sum("payment_value").alias("amount"), F.count("*").alias("rows"))


def order_payment_summary(m: Commerce) -> DataFrame:
    """Totals, main type and the split by type per order, in one aggregate over the payments.
    The split holds one entry per payment type, a handful at most; views by type unfold it
    instead of reading the payments again."""
    return (order_type_amounts(m).groupBy("order_id").agg(
        F.sum("amount").alias("order_payment_amount"), F.sum("rows").alias("payment_row_count"),
        F.count("*").alias("payment_type_count"),
        F.collect_list(F.struct("payment_type", "amount")).alias("split"))
        .withColumn("p", F.array_min(F.transform("split", lambda x: F.struct(
            (-x["amount"]).alias("minus"), x["payment_type"].alias("payment_type")))))
        .withColumn("primary_payment_type", F.col("p.payment_type"))
        .withColumn("primary_payment_type_amount", -F.col("p.minus"))
        .withColumn("top_type_count", F.size(F.filter("split", lambda x: x["amount"] == -F.col("p.minus"))))
        .drop("p"))


def structure_order_base(m: Commerce, bounds: Sequence[float] = BOUNDS, periods=PERIODS) -> DataFrame:
    """Clean orders of every status with payment totals, band and comparable period."""
    ts = F.col("order_purchase_timestamp")
    month = month_of(ts)
    pay = order_payment_summary(m)
    paid = F.col("order_payment_amount")
    orders = m.orders_core.where(F.col("order_id").isNotNull() & ts.isNotNull()
                                 & F.col("order_estimated_delivery_date").isNotNull())
    done = F.col("order_status") == "delivered"
    return (orders.join(m.customers.select("customer_id", "customer_unique_id", "customer_state"), "customer_id")
            .join(pay, "order_id", "left").select(
        "order_id", "customer_id", "customer_unique_id", "customer_state", "order_status", ts,
        month.alias("purchase_month"), F.year(ts).cast("bigint").alias("purchase_year"), paid,
        F.coalesce("payment_row_count", F.lit(0)).cast("bigint").alias("payment_row_count"),
        F.coalesce("payment_type_count", F.lit(0)).cast("bigint").alias("payment_type_count"),
        flag(F.col("payment_type_count") > 1).alias("is_mixed_payment"),
        flag(done).alias("is_delivered_order"), flag(done & (paid > 0)).alias("is_paid_delivered_order"),
        value_band(paid, bounds).alias("order_value_band"),
        _period_column(month, periods).alias("comparable_period"),
        "primary_payment_type", "primary_payment_type_amount", "top_type_count", "split"))


def structure_order_base_report(m: Commerce, bounds=BOUNDS, periods=PERIODS) -> DataFrame:
    return structure_order_base(m, bounds, periods).drop(
        "primary_payment_type", "primary_payment_type_amount", "top_type_count", "split").withColumn(
        "order_payment_amount", dbl("order_payment_amount"))


def paid_orders(m: Commerce, bounds=BOUNDS, periods=PERIODS) -> DataFrame:
    return structure_order_base(m, bounds, periods).where("is_paid_delivered_order = 1")


def by_type(orders: DataFrame) -> DataFrame:
    """Orders unfolded to one row per payment type used."""
    return orders.withColumn("s", F.explode("split")).withColumn("payment_type", F.col("s.payment_type")).withColumn(
        "type_amount", F.col("s.amount")).drop("s", "split")


def order_payment_split(m: Commerce) -> DataFrame:
    return by_type(paid_orders(m)).select("order_id", "payment_type", dbl("type_amount").alias("payment_type_amount"))


def primary_payment(m: Commerce) -> DataFrame:
    """Type with the largest amount; equal amounts go to the alphabetically first type."""
    return paid_orders(m).select(
        "order_id", "primary_payment_type", dbl("primary_payment_type_amount").alias("primary_payment_type_amount"),
        dbl("order_payment_amount").alias("order_payment_amount"), "payment_type_count", "is_mixed_payment")


def payment_tie_audit(m: Commerce) -> DataFrame:
    return paid_orders(m).agg(count_if(F.col("top_type_count") > 1).alias("orders_with_top_amount_tie"))


# ------------------------------------------------------------ period structures

def _by_period(stats: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Roll stats per comparable period up into ALL_DATA and the periods. The input is already
    aggregated, so the fact table is scanned once and not once per period."""
    tags = F.array_compact(F.array(F.lit(ALL), F.col("comparable_period")))
    return (stats.withColumn("period", F.explode(tags)).groupBy("period", *keys)
            .agg(*[F.sum(c).alias(c) for c in sums]))


def _period_frame(spark, periods) -> DataFrame:
    names = [ALL, *[p[0] for p in periods]]
    return literal_rows(spark, "period_order bigint, period string", list(enumerate(names, 1)))


def _share(value, by) -> object:
    return half_up(ratio(value, by), 6)


def _totals(gmv: str, orders: str):
    """Totals of a period, taken over the few rows of its report."""
    w = W.partitionBy("period")
    return F.sum(gmv).over(w), F.sum(orders).over(w)


def payment_structure(m: Commerce, periods=PERIODS, orders: DataFrame | None = None) -> DataFrame:
    """Per period and payment type: revenue by the type used, and orders with their whole amount
    under the main type. One pass over the orders unfolded by type feeds both."""
    orders = paid_orders(m, periods=periods) if orders is None else orders
    main = F.col("payment_type") == F.col("primary_payment_type")
    sums = ["split_gmv", "primary_order_count", "attributed_order_gmv", "mixed_payment_orders"]
    stats = by_type(orders).groupBy("comparable_period", "payment_type").agg(
        F.sum("type_amount").alias("split_gmv"), count_if(main).alias("primary_order_count"),
        F.sum(F.when(main, F.col("order_payment_amount"))).alias("attributed_order_gmv"),
        F.sum(F.when(main, F.col("is_mixed_payment"))).alias("mixed_payment_orders"))
    stats = _by_period(stats, ["payment_type"], sums)
    types = stats.where(F.col("period") == ALL).select("payment_type")
    grid = with_values(types, "period", [ALL, *[p[0] for p in periods]]).join(_period_frame(m.spark, periods), "period")
    zero = F.lit(0).cast("decimal(38,2)")
    wide = (grid.join(stats, ["period", "payment_type"], "left")
            .na.fill(0, ["primary_order_count", "mixed_payment_orders"])
            .withColumn("split_gmv", F.coalesce("split_gmv", zero))
            .withColumn("attributed_order_gmv", F.coalesce("attributed_order_gmv", zero)))
    total_gmv, total_orders = _totals("attributed_order_gmv", "primary_order_count")
    return wide.select(
        "period_order", "period", "payment_type", dbl("split_gmv").alias("split_gmv"),
        dbl("attributed_order_gmv").alias("attributed_order_gmv"), "primary_order_count",
        half_up(ratio("attributed_order_gmv", "primary_order_count"), 2).alias("average_order_value"),
        _share("split_gmv", total_gmv).alias("gmv_share"), _share("primary_order_count", total_orders).alias("order_share"),
        "mixed_payment_orders",
        F.coalesce(_share("mixed_payment_orders", "primary_order_count"), F.lit(0.0)).alias("mixed_payment_order_share"),
        dbl(total_gmv).alias("total_gmv"), total_orders.alias("total_paid_orders"))


def order_value_structure(m: Commerce, bounds=BOUNDS, periods=PERIODS, orders: DataFrame | None = None) -> DataFrame:
    orders = paid_orders(m, bounds, periods) if orders is None else orders
    stats = orders.groupBy("comparable_period", "order_value_band").agg(
        F.count("*").alias("paid_order_count"), F.sum("order_payment_amount").alias("gmv"))
    stats = _by_period(stats, ["order_value_band"], ["paid_order_count", "gmv"])
    bands = literal_rows(m.spark, "band_order bigint, order_value_band string", list(enumerate(band_names(bounds), 1)))
    grid = with_values(bands, "period", [ALL, *[p[0] for p in periods]]).join(_period_frame(m.spark, periods), "period")
    wide = (grid.join(stats, ["period", "order_value_band"], "left").na.fill(0, ["paid_order_count"])
            .withColumn("gmv", F.coalesce("gmv", F.lit(0).cast("decimal(38,2)"))))
    total_gmv, total_orders = _totals("gmv", "paid_order_count")
    return wide.select(
        "period_order", "period", "band_order", "order_value_band", "paid_order_count", dbl("gmv").alias("gmv"),
        half_up(ratio("gmv", "paid_order_count"), 2).alias("average_order_value"),
        _share("paid_order_count", total_orders).alias("paid_order_share"), _share("gmv", total_gmv).alias("gmv_share"),
        total_orders.alias("total_paid_orders"), dbl(total_gmv).alias("total_gmv"))


def _state_rows(m: Commerce, periods, orders: DataFrame | None = None) -> DataFrame:
    """State by period at full precision. Users are counted at user grain, where a user is one
    row per period however many orders the user placed."""
    tags = F.array_compact(F.array(F.lit(ALL), F.col("comparable_period")))
    orders = paid_orders(m, periods=periods) if orders is None else orders
    per_user = orders.groupBy("customer_state", "customer_unique_id", "comparable_period").agg(
        F.count("*").alias("orders"), F.sum("order_payment_amount").alias("gmv"))
    stats = (per_user.withColumn("period", F.explode(tags)).groupBy("period", "customer_state", "customer_unique_id")
             .agg(F.sum("orders").alias("orders"), F.sum("gmv").alias("gmv"))
             .groupBy("period", "customer_state").agg(
                 F.sum("orders").alias("paid_order_count"), F.count("*").alias("customer_count"), F.sum("gmv").alias("gmv")))
    states = stats.where(F.col("period") == ALL).select("customer_state")
    grid = with_values(states, "period", [ALL, *[p[0] for p in periods]]).join(_period_frame(m.spark, periods), "period")
    wide = (grid.join(stats, ["period", "customer_state"], "left").na.fill(0, ["paid_order_count", "customer_count"])
            .withColumn("gmv", F.coalesce("gmv", F.lit(0).cast("decimal(38,2)"))))
    total_gmv, total_orders = _totals("gmv", "paid_order_count")
    rank = F.row_number().over(W.partitionBy("period").orderBy(F.desc("gmv"), "customer_state")).cast("bigint")
    return wide.withColumn("total_gmv", total_gmv).withColumn("total_paid_orders", total_orders).withColumn("gmv_rank", rank)


def _state_report(rows: DataFrame) -> DataFrame:
    return rows.select(
        "period_order", "period", "customer_state", "paid_order_count", "customer_count", dbl("gmv").alias("gmv"),
        half_up(ratio("gmv", "paid_order_count"), 2).alias("average_order_value"),
        _share("paid_order_count", "total_paid_orders").alias("paid_order_share"),
        _share("gmv", "total_gmv").alias("gmv_share"), "gmv_rank", "total_paid_orders",
        dbl("total_gmv").alias("total_gmv"))


def state_structure(m: Commerce, periods=PERIODS, orders: DataFrame | None = None) -> DataFrame:
    return _state_report(_state_rows(m, periods, orders))


def state_concentration(m: Commerce, periods=PERIODS) -> DataFrame:
    """Top-5 and top-10 shares and the concentration index, from unrounded shares."""
    rows = _state_rows(m, periods)
    g, o = ratio("gmv", "total_gmv"), ratio("paid_order_count", "total_paid_orders")
    top = lambda k, c, total: half_up(ratio(F.sum(F.when(F.col("gmv_rank") <= k, F.col(c))), F.max(total)), 6)
    return rows.groupBy("period_order", "period").agg(
        top(5, "gmv", "total_gmv").alias("top_5_gmv_share"), top(10, "gmv", "total_gmv").alias("top_10_gmv_share"),
        top(5, "paid_order_count", "total_paid_orders").alias("top_5_paid_order_share"),
        top(10, "paid_order_count", "total_paid_orders").alias("top_10_paid_order_share"),
        half_up(F.sum(g * g) * 10000, 2).alias("state_gmv_hhi"),
        half_up(F.sum(o * o) * 10000, 2).alias("state_paid_order_hhi"), F.count("*").alias("state_count"))


def state_change(m: Commerce, periods=PERIODS) -> DataFrame:
    """Two comparable periods side by side per state, with growth and a four-way segment.
    The scale benchmark is an equal share over the observed states."""
    (old_name, _, _), (new_name, _, _) = periods[0], periods[1]
    a, b = old_name[:4], new_name[:4]
    rows = _state_report(_state_rows(m, periods)).where(F.col("period") != ALL)
    cols = ["paid_order_count", "customer_count", "gmv", "average_order_value", "paid_order_share", "gmv_share",
            "gmv_rank", "total_gmv"]
    at = lambda c, p: F.max(F.when(F.col("period") == p, F.col(c)))
    wide = rows.groupBy("customer_state").agg(
        *[at(c, p).alias(f"{c}_{s}") for c in cols for p, s in ((old_name, a), (new_name, b))])
    grow = lambda c: F.when(F.col(f"{c}_{a}") > 0, half_up(ratio(f"{c}_{b}", f"{c}_{a}") - 1, 6))
    platform = ratio(f"total_gmv_{b}", f"total_gmv_{a}") - 1
    wide = (wide.withColumn("gmv_growth_rate", grow("gmv")).withColumn("_p", platform)
            .withColumn("_e", 1.0 / F.count("*").over(W.partitionBy())))
    big, fast = F.col(f"gmv_share_{b}") >= F.col("_e"), F.col("gmv_growth_rate") >= F.col("_p")
    slow = F.col("gmv_growth_rate") < F.col("_p")
    return wide.select(
        "customer_state", *[f"{c}_{s}" for c in cols[:-1] for s in (a, b)], "gmv_growth_rate",
        grow("paid_order_count").alias("paid_order_growth_rate"), grow("customer_count").alias("customer_growth_rate"),
        grow("average_order_value").alias("average_order_value_growth_rate"),
        half_up(F.col(f"gmv_share_{b}") - F.col(f"gmv_share_{a}"), 6).alias("gmv_share_change"),
        half_up(F.col(f"paid_order_share_{b}") - F.col(f"paid_order_share_{a}"), 6).alias("paid_order_share_change"),
        half_up("_p", 6).alias("platform_gmv_growth_rate"),
        half_up(F.col("gmv_growth_rate") - F.col("_p"), 6).alias("growth_gap_vs_platform"),
        half_up("_e", 6).alias("equal_state_share_benchmark"),
        F.when(big & fast, "HIGH_SCALE_HIGH_GROWTH").when(big & slow, "HIGH_SCALE_LOW_GROWTH")
        .when(~big & fast, "LOW_SCALE_HIGH_GROWTH").otherwise("LOW_SCALE_LOW_GROWTH").alias("state_structure_segment"))


def state_segment_counts(m: Commerce, periods=PERIODS) -> DataFrame:
    return state_change(m, periods).groupBy("state_structure_segment").agg(F.count("*").alias("state_count"))


def structure_reconcile(m: Commerce, bounds=BOUNDS, periods=PERIODS) -> DataFrame:
    """Do the parts of each structure add up to its totals, per period? The totals are counted
    from the orders, independently of the reports."""
    orders = materialize(paid_orders(m, bounds, periods).select(  # read by four branches
        "order_id", "customer_unique_id", "customer_state", "order_value_band", "comparable_period",
        "order_payment_amount", "is_mixed_payment", "primary_payment_type", "split"))
    expected = _by_period(orders.groupBy("comparable_period").agg(
        F.count("*").alias("expected_orders"), F.sum("order_payment_amount").alias("expected_gmv")),
        [], ["expected_orders", "expected_gmv"])
    parts = [("payment", payment_structure(m, periods, orders), "primary_order_count", "split_gmv", "order_share"),
             ("order_value", order_value_structure(m, bounds, periods, orders), "paid_order_count", "gmv", "paid_order_share"),
             ("state", state_structure(m, periods, orders), "paid_order_count", "gmv", "paid_order_share")]
    summed = [df.groupBy("period").agg(
        F.sum(o).alias("summed_orders"), half_up(F.sum(g), 2).alias("summed_gmv"),
        half_up(F.sum("gmv_share"), 4).alias("summed_gmv_share"), half_up(F.sum(s), 4).alias("summed_order_share"))
        .withColumn("structure", F.lit(name)) for name, df, o, g, s in parts]
    return reduce(DataFrame.unionByName, summed).join(expected, "period").select(
        "structure", "period", "summed_orders", "expected_orders", "summed_gmv",
        half_up(dbl("expected_gmv"), 2).alias("expected_gmv"), "summed_gmv_share", "summed_order_share")


# ------------------------------------------------------------ detail and filters

def payment_detail_base(m: Commerce, bounds=BOUNDS) -> DataFrame:
    """Order by payment type with shares, main-type attribution and first paid month."""
    orders = paid_orders(m, bounds).where(F.trim("customer_state") != "")
    first = orders.groupBy("customer_unique_id").agg(
        F.min("order_purchase_timestamp").alias("first_paid_purchase_timestamp"))
    main = F.col("payment_type") == F.col("primary_payment_type")
    return (by_type(orders.join(first, "customer_unique_id")).select(
        "order_id", "customer_id", "customer_unique_id", "customer_state", "order_purchase_timestamp",
        F.to_date("order_purchase_timestamp").alias("purchase_date"), "purchase_month", "purchase_year",
        F.concat(F.lit("Q"), F.quarter("order_purchase_timestamp")).alias("purchase_quarter"),
        "order_payment_amount", "order_value_band", "payment_type", F.col("type_amount").alias("payment_gmv"),
        _share("type_amount", "order_payment_amount").alias("payment_share_of_order"),
        "payment_type_count", "is_mixed_payment", "primary_payment_type", flag(main).alias("is_primary_payment_type"),
        F.when(main, F.col("order_payment_amount")).otherwise(F.lit(0)).alias("primary_attributed_order_gmv"),
        "first_paid_purchase_timestamp", month_of("first_paid_purchase_timestamp").alias("first_paid_purchase_month"),
        flag(F.col("purchase_month") == month_of("first_paid_purchase_timestamp")).alias("is_new_user_order_month")))


def payment_detail_report(m: Commerce, bounds=BOUNDS) -> DataFrame:
    out = payment_detail_base(m, bounds)
    for c in ("order_payment_amount", "payment_gmv", "primary_attributed_order_gmv"):
        out = out.withColumn(c, dbl(c))
    return out


def filter_detail(m: Commerce, f, bounds=BOUNDS) -> DataFrame:
    """Detail rows under the global filters. A payment filter keeps every row of an order that
    used one of the wanted types."""
    rows = payment_detail_base(m, bounds).where(
        F.col("purchase_date").between(F.lit(f.first_day).cast("date"), F.lit(f.last_day).cast("date")))
    if f.states:
        rows = rows.where(F.col("customer_state").isin(*f.states))
    if f.bands:
        rows = rows.where(F.col("order_value_band").isin(*f.bands))
    if f.payments:
        used = C.positive_payments(m).where(F.col("payment_type").isin(*f.payments)).select("order_id")
        rows = rows.join(used, "order_id", "left_semi")
    return rows


def payment_structure_filtered(m: Commerce, f, bounds=BOUNDS, rows: DataFrame | None = None) -> DataFrame:
    rows = filter_detail(m, f, bounds) if rows is None else rows
    split = rows.groupBy("payment_type").agg(F.sum("payment_gmv").alias("split_gmv"))
    main = rows.where("is_primary_payment_type = 1").groupBy(F.col("primary_payment_type").alias("payment_type")).agg(
        F.sum("order_payment_amount").alias("attributed_order_gmv"), F.count("*").alias("primary_order_count"),
        F.sum("is_mixed_payment").alias("mixed_payment_orders"))
    zero = F.lit(0).cast("decimal(38,2)")
    wide = (split.join(main, "payment_type", "outer").na.fill(0, ["primary_order_count", "mixed_payment_orders"])
            .withColumn("split_gmv", F.coalesce("split_gmv", zero))
            .withColumn("attributed_order_gmv", F.coalesce("attributed_order_gmv", zero)))
    a = W.partitionBy()
    gmv, orders = F.sum("attributed_order_gmv").over(a), F.sum("primary_order_count").over(a)
    nil = F.lit(0.0)
    return wide.select(
        "payment_type", dbl("split_gmv").alias("split_gmv"), dbl("attributed_order_gmv").alias("attributed_order_gmv"),
        "primary_order_count", "mixed_payment_orders",
        ratio("attributed_order_gmv", "primary_order_count").alias("average_order_value"),
        F.coalesce(ratio("split_gmv", gmv), nil).alias("gmv_share"),
        F.coalesce(ratio("primary_order_count", orders), nil).alias("order_share"),
        F.coalesce(ratio("mixed_payment_orders", "primary_order_count"), nil).alias("mixed_payment_order_share"))


def _simple_structure(rows: DataFrame, key: str, with_users: bool) -> DataFrame:
    """Revenue, orders and shares per key. An order has one state and one band, so its main-type
    row stands for it and no distinct count of orders is needed."""
    orders = rows.where("is_primary_payment_type = 1")
    per_user = orders.groupBy(key, "customer_unique_id").agg(
        F.sum("order_payment_amount").alias("gmv"), F.count("*").alias("orders"))
    stats = per_user.groupBy(key).agg(F.sum("gmv").alias("gmv"), F.sum("orders").alias("order_count"),
                                      F.count("*").alias("customer_count"))
    a = W.partitionBy()
    out = [key, dbl("gmv").alias("gmv"), "order_count", ratio("gmv", "order_count").alias("average_order_value"),
           ratio("gmv", F.sum("gmv").over(a)).alias("gmv_share"),
           ratio("order_count", F.sum("order_count").over(a)).alias("order_share")]
    if with_users:
        out += ["customer_count", F.row_number().over(a.orderBy(F.desc("gmv"), key)).cast("bigint").alias("gmv_rank")]
    return stats.select(*out)


def value_structure_filtered(m: Commerce, f, bounds=BOUNDS, rows: DataFrame | None = None) -> DataFrame:
    return _simple_structure(filter_detail(m, f, bounds) if rows is None else rows, "order_value_band", False)


def state_structure_filtered(m: Commerce, f, bounds=BOUNDS, rows: DataFrame | None = None) -> DataFrame:
    return _simple_structure(filter_detail(m, f, bounds) if rows is None else rows, "customer_state", True)


def structural_signals(m: Commerce, f, bounds=BOUNDS) -> DataFrame:
    """Two strongest concentration risks (leading share over an equal share) and up to two
    opportunities (most revenue per order share; largest state outside the top five)."""
    a = W.partitionBy()  # all inputs are report-sized
    rows = materialize(filter_detail(m, f, bounds).select(  # read by three reports
        "payment_type", "payment_gmv", "primary_payment_type", "is_primary_payment_type", "order_payment_amount",
        "is_mixed_payment", "order_value_band", "customer_state", "customer_unique_id"))
    pay = payment_structure_filtered(m, f, bounds, rows).withColumn("n", F.count("*").over(a)).withColumn(
        "r", F.row_number().over(a.orderBy(F.desc("split_gmv"), "payment_type")))
    band = value_structure_filtered(m, f, bounds, rows).where("order_count > 0").withColumn("n", F.count("*").over(a))
    state = state_structure_filtered(m, f, bounds, rows).withColumn("n", F.count("*").over(a))
    row = lambda kind, dim, subject, score, share: [
        F.lit(kind).alias("signal_type"), F.lit(dim).alias("dimension"), subject.alias("subject"),
        score.alias("score"), share.alias("gmv_share")]
    lead_pay = pay.where("n >= 2 AND r = 1").select(*row(
        "risk", "payment_type", F.col("payment_type"), F.col("gmv_share") * F.col("n"), F.col("gmv_share")))
    lead_band = band.where("n >= 2").withColumn("r", F.row_number().over(a.orderBy(F.desc("gmv"), "order_value_band"))).where(
        "r = 1").select(*row("risk", "order_value_band", F.col("order_value_band"),
                             F.col("gmv_share") * F.col("n"), F.col("gmv_share")))
    share5 = F.sum(F.when(F.col("gmv_rank") <= 5, F.col("gmv").cast("decimal(38,2)")))
    lead_state = state.where("n >= 2").agg(
        ratio(share5, F.sum(F.col("gmv").cast("decimal(38,2)"))).alias("s"), F.max("n").alias("n")).where("n IS NOT NULL").select(
        *row("risk", "customer_state", F.lit("top 5 states"),
             F.col("s") / (F.least(F.lit(5), F.col("n")) / F.col("n")), F.col("s")))
    risks = reduce(DataFrame.unionByName, [lead_pay, lead_band, lead_state])
    eff = ratio("gmv_share", "order_share")
    best_band = (band.withColumn("e", eff).where("order_share > 0")
                 .withColumn("r", F.row_number().over(a.orderBy(F.desc("e"), F.desc("gmv_share")))).where("r = 1")
                 .select(*row("opportunity", "order_value_band", F.col("order_value_band"), F.col("e"), F.col("gmv_share"))))
    overall = ratio(F.sum(F.col("gmv").cast("decimal(38,2)")).over(a), F.sum("order_count").over(a))
    next_state = state.withColumn("k", ratio("average_order_value", overall)).where("gmv_rank = 6").select(
        *row("opportunity", "customer_state", F.col("customer_state"),
             F.col("gmv_share") * F.greatest(F.col("k"), F.lit(0.01)), F.col("gmv_share")))
    pay_overall = ratio(F.sum(F.col("attributed_order_gmv").cast("decimal(38,2)")).over(a),
                        F.sum("primary_order_count").over(a))
    spare = (pay.withColumn("k", ratio("average_order_value", pay_overall)).where("n >= 2 AND r > 1")
             .withColumn("q", F.row_number().over(a.orderBy(F.desc("average_order_value"), F.desc("split_gmv"))))
             .where("q = 1").select(*row("opportunity", "payment_type", F.col("payment_type"), F.col("k"), F.col("gmv_share"))))
    prefer = lambda df, k: df.withColumn("fallback", F.lit(k))
    chances = reduce(DataFrame.unionByName, [prefer(best_band, 0), prefer(next_state, 0), prefer(spare, 1)])
    chances = chances.withColumn("i", F.row_number().over(a.orderBy("fallback", F.desc("score")))).where("i <= 2")
    rank = W.partitionBy("signal_type").orderBy(F.desc("score"), "dimension")
    return (risks.unionByName(chances.drop("i", "fallback"))
            .withColumn("signal_rank", F.row_number().over(rank).cast("bigint")).where("signal_rank <= 2")
            .select("signal_type", "signal_rank", "dimension", "subject",
                    half_up("score", 6).alias("score"), half_up("gmv_share", 6).alias("gmv_share")))
