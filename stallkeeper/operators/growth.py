"""Growth and trend diagnostics over the monthly KPI series.

Every frame here has one row per month (times a metric or a series), so ordering it in
a single task is safe at any fact-table size.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from stallkeeper.functions import half_up, count_if, dbl, flag, materialize, month_index, ratio, scalar, shift_month
from stallkeeper.operators.kpi import METRICS, fill_months, monthly_kpi, monthly_kpi_by_state
from stallkeeper.sources.model import Commerce

SHORT = {"gmv": "gmv", "order_count": "order_count", "average_order_value": "aov", "new_users": "new_users",
         "active_users": "active_users"}


def _by_month():
    return W.partitionBy().orderBy("month")


def _change(c: str, lag: int):
    before = F.lag(c, lag).over(_by_month())
    return ratio(dbl(c) - dbl(before), before)


def growth_mom_yoy(m: Commerce) -> DataFrame:
    """MoM and YoY of the five metrics on a calendar without gaps."""
    return fill_months(monthly_kpi(m)).select(
        "month", *[half_up(_change(c, k), 4).alias(f"{SHORT[c]}_{n}")
                   for c in METRICS for n, k in (("mom", 1), ("yoy", 12))])


# The texts in the two functions below are fixed values of the reports.
def growth_driver(m: Commerce) -> DataFrame:
    """What moved GMV in months it grew; compares with the previous observed month."""
    before = {c: F.lag(c).over(_by_month()) for c in ("gmv", "order_count", "average_order_value")}
    up = {c: F.col(c) > b for c, b in before.items()}
    return monthly_kpi(m).select(
        "month", F.when(up["gmv"], "growth").alias("gmv_growth_flag"),
        F.when(up["gmv"] & up["order_count"] & up["average_order_value"], "Both")
        .when(up["gmv"] & up["order_count"], "Order volume driven")
        .when(up["gmv"] & up["average_order_value"], "AOV driven")
        .when(up["gmv"], "Mixed").alias("growth_driver"))


def growth_extremes(m: Commerce) -> DataFrame:
    """Fastest growth, largest decline and changes beyond two population deviations."""
    g = monthly_kpi(m).withColumn("mom", _change("gmv", 1)).where("mom IS NOT NULL")
    a = W.partitionBy()
    mom, top, low = F.col("mom"), F.max("mom").over(a), F.min("mom").over(a)
    far = F.abs(mom - F.avg("mom").over(a)) > 2 * F.stddev_pop("mom").over(a)
    part = lambda c, text: F.when(c, text).otherwise("")
    return g.select("month", half_up(mom, 4).alias("gmv_mom_rate"), F.concat(
        part(mom == top, "Fastest growth; "), part(mom == low, "Largest decline; "),
        part(far, "Abnormal volatility; "), part((mom != top) & (mom != low) & ~far, "Normal")).alias("label"))


def growth_anomaly_iqr(m: Commerce) -> DataFrame:
    """Months with too few orders or an extreme GMV change, by nearest-rank fences."""
    g = materialize(monthly_kpi(m).select("month", half_up(_change("gmv", 1), 4).alias("gmv_mom_change"),
                                          F.col("order_count").alias("monthly_order_count")))  # one row per month
    disc = lambda c, p: F.expr(f"percentile_disc({p}) within group (order by {c})")
    q = scalar(g.agg(disc("monthly_order_count", 0.25).alias("o1"), disc("monthly_order_count", 0.75).alias("o3"),
                     disc("gmv_mom_change", 0.25).alias("g1"), disc("gmv_mom_change", 0.75).alias("g3")),
               "o1", "o3", "g1", "g3")
    spread = F.col("q.g3") - F.col("q.g1")
    few = F.col("monthly_order_count") < F.col("q.o1") - 1.5 * (F.col("q.o3") - F.col("q.o1"))
    high = F.col("gmv_mom_change") > F.col("q.g3") + 1.5 * spread
    low = F.col("gmv_mom_change") < F.col("q.g1") - 1.5 * spread
    text = F.concat_ws(", ", F.when(few, "order_count_too_low"),
                       F.when(high, "extreme_increase").when(low, "extreme_decrease"))
    return g.withColumn("q", q).withColumn("diagnosis", text).where(F.col("diagnosis") != "").drop("q")


def growth_stability(m: Commerce, min_orders: int = 1000, limit: float = 5) -> DataFrame:
    g = monthly_kpi(m).withColumn("mom", _change("gmv", 1))
    kept = g.where((F.col("order_count") >= min_orders) & F.col("mom").between(-limit, limit))
    return kept.agg(half_up(F.stddev_pop("mom"), 4).alias("growth_rate_std"))


# ------------------------------------------------------------ trend diagnostics

def trend_diagnostics(m: Commerce, boundary_months: list[str]) -> DataFrame:
    """MoM percentages with eligibility, interpolated IQR fences, anomaly flags and driver.
    A month is eligible when neither it nor its predecessor is a boundary month and no month
    is missing between them."""
    w = _by_month()
    base = (monthly_kpi(m).withColumn("is_boundary_month", F.col("month").isin(*boundary_months))
            .withColumn("previous_observed_month", F.lag("month").over(w))
            .withColumn("data_gap_before", F.coalesce(
                month_index("month") - month_index("previous_observed_month") != 1, F.lit(False)))
            .withColumn("mom_eligible", ~F.col("is_boundary_month") & ~F.col("data_gap_before")
                        & ~F.coalesce(F.lag("is_boundary_month").over(w), F.lit(True))))
    for c in METRICS:
        base = base.withColumn(f"{c}_mom_pct", (ratio(c, F.lag(c).over(w)) - 1) * 100)
    a = W.partitionBy()
    for c in METRICS:
        pct = F.when(F.col("mom_eligible"), F.col(f"{c}_mom_pct"))
        base = base.withColumn("_q", F.percentile(pct, F.array(F.lit(0.25), F.lit(0.75))).over(a))
        spread = F.col("_q")[1] - F.col("_q")[0]
        base = (base.withColumn(f"{c}_iqr_lower_pct", F.col("_q")[0] - 1.5 * spread)
                .withColumn(f"{c}_iqr_upper_pct", F.col("_q")[1] + 1.5 * spread)
                .withColumn(f"{c}_anomaly", F.coalesce(F.col("mom_eligible") & (
                    (F.col(f"{c}_mom_pct") < F.col(f"{c}_iqr_lower_pct"))
                    | (F.col(f"{c}_mom_pct") > F.col(f"{c}_iqr_upper_pct"))), F.lit(False))).drop("_q"))
    flags = {c: F.col(f"{c}_anomaly") for c in METRICS}
    orders, aov = F.col("order_count_mom_pct"), F.col("average_order_value_mom_pct")
    same = F.signum(orders) == F.signum(aov)
    any_flag = reduce(lambda x, y: x | y, flags.values())
    driver = (F.when(~any_flag, "").when(~flags["gmv"], "gmv_within_fences")
              .when(flags["average_order_value"] & same, "orders_and_aov_both_anomalous")
              .when(F.abs(orders) > F.abs(aov) * 2, "mainly_orders")
              .when(same, "orders_and_aov_same_direction").otherwise("opposite_directions"))
    rounded = [c for c in base.columns if c.endswith("_pct")]
    return base.select(
        *[half_up(c, 6).alias(c) if c in rounded else F.col(c) for c in base.columns],
        F.concat_ws(";", *[F.when(f, c) for c, f in flags.items()]).alias("anomaly_metrics"),
        reduce(lambda x, y: x + y, [flag(f) for f in flags.values()]).alias("anomaly_count"),
        driver.alias("driver"))


def _long(kpi: DataFrame) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), dbl(c).alias("value")) for c in METRICS])
    return kpi.select("month", F.explode(cells).alias("c")).select("month", "c.metric", "c.value")


def peak_trough(m: Commerce, boundary_months: list[str]) -> DataFrame:
    """Best and worst month per metric; the earliest month wins a tie."""
    rows = _long(monthly_kpi(m)).where(~F.col("month").isin(*boundary_months) & F.col("value").isNotNull())
    return rows.groupBy("metric").agg(
        F.max_by("month", F.struct("value", -month_index("month"))).alias("peak_month"),
        F.max("value").alias("peak_value"),
        F.min_by("month", F.struct("value", month_index("month"))).alias("trough_month"),
        F.min("value").alias("trough_value"))


def month_gap_audit(m: Commerce, kpi: DataFrame | None = None) -> DataFrame:
    """Missing and repeated months and null counts of a KPI series."""
    kpi = monthly_kpi(m) if kpi is None else kpi
    per_month = kpi.groupBy("month").agg(F.count("*").alias("rows"),
                                         *[count_if(F.col(c).isNull()).alias(c) for c in METRICS])
    filled = fill_months(per_month)
    missing = F.col("rows").isNull()
    return filled.agg(
        F.sum("rows").alias("row_count"), F.min("month").alias("start_month"), F.max("month").alias("end_month"),
        count_if(missing).alias("missing_month_count"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(missing, F.col("month"))))).alias("missing_months"),
        F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows"))), F.lit(0)).alias("duplicate_months"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"null_{c}") for c in METRICS])


def mom_outlier_trim(m: Commerce) -> DataFrame:
    """MoM series with values outside the interpolated IQR fences set to NULL."""
    cols = [f"{SHORT[c]}_mom" for c in METRICS]
    g = growth_mom_yoy(m).select("month", *cols)
    a = W.partitionBy()
    out = []
    for c in cols:
        q = F.percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.75))).over(a)
        spread = q[1] - q[0]
        out.append(F.when(F.col(c).between(q[0] - 1.5 * spread, q[1] + 1.5 * spread), F.col(c)).alias(c))
    return g.select("month", *out)


def growth_status(m: Commerce) -> DataFrame:
    """Growth of every metric with its comparison base and the flags needed to read it:
    base in the lowest decile of positive bases, or first or last month of the series."""
    kpi = fill_months(monthly_kpi(m))
    w, a = W.partitionBy("metric", "comparison").orderBy("month"), W.partitionBy("metric", "comparison")
    long = _long(kpi).withColumn("comparison", F.explode(F.array(F.lit("mom"), F.lit("yoy"))))
    is_mom = F.col("comparison") == "mom"
    base = F.when(is_mom, F.lag("value", 1).over(w)).otherwise(F.lag("value", 12).over(w))
    out = (long.withColumn("comparison_base_value", base)
           .withColumn("growth_rate", half_up(ratio(F.col("value") - base, base), 4))
           .withColumn("cutoff", F.percentile(F.when(F.col("value") > 0, F.col("value")), F.lit(0.1)).over(a))
           .withColumn("is_coverage_boundary", (F.col("month") == F.min("month").over(a))
                       | (F.col("month") == F.max("month").over(a))))
    low = F.col("growth_rate").isNotNull() & (
        F.col("comparison_base_value").isNull() | (F.col("comparison_base_value") <= 0)
        | (F.col("comparison_base_value") <= F.col("cutoff")))
    text = F.concat_ws(" + ", F.when(F.col("is_low_base"), "Low comparison base"),
                       F.when(F.col("is_coverage_boundary"), "Coverage-boundary month"))
    return out.withColumn("is_low_base", low).select(
        "month", "metric", "comparison", "growth_rate",
        F.when(is_mom, shift_month("month", -1)).otherwise(shift_month("month", -12)).alias("comparison_base_month"),
        "comparison_base_value", "is_low_base", "is_coverage_boundary",
        (F.col("is_low_base") | F.col("is_coverage_boundary")).alias("is_interpretation_flag"),
        F.when(F.col("growth_rate").isNull(), "No comparable period")
        .when(text == "", "Comparable").otherwise(text).alias("status"),
        (F.col("growth_rate") * 100).alias("growth_pct"))


def growth_decomposition(m: Commerce) -> DataFrame:
    """GMV growth as order effect + AOV effect + interaction."""
    g = growth_mom_yoy(m)
    cells = F.array(*[F.struct(F.lit(k).alias("comparison"), F.col(f"gmv_{k}").alias("reported_gmv_growth"),
                               F.col(f"order_count_{k}").alias("order_effect"), F.col(f"aov_{k}").alias("aov_effect"))
                      for k in ("mom", "yoy")])
    long = g.select("month", F.explode(cells).alias("c")).select("month", "c.*")
    inter = F.col("order_effect") * F.col("aov_effect")
    total = F.col("order_effect") + F.col("aov_effect") + inter
    return long.select("*", half_up(inter, 8).alias("interaction_effect"),
                       half_up(total, 8).alias("reconstructed_gmv_growth"),
                       half_up(F.col("reported_gmv_growth") - total, 8).alias("reconstruction_difference"))


# ------------------------------------------------------------ regimes

REGIME_METRICS = ["gmv", "order_count", "new_users", "active_users"]


def regime_segmentation(m: Commerce, boundary_months: list[str], min_length: int = 3, max_stages: int = 4) -> DataFrame:
    """Split the monthly series of every state into one to four ordered regimes.

    The cost of a segment is the squared error of the z-scored log1p metrics; the number of
    regimes minimises BIC. The shortest-path recursion runs as one join and one ``min_by``
    per extra regime for all series at once. A series has at most one row per calendar month,
    so its segments are bounded by the square of the months observed, never by the orders.
    """
    key = "customer_state"
    kpi = monthly_kpi_by_state(m).where(~F.col("month").isin(*boundary_months))
    whole, order = W.partitionBy(key), W.partitionBy(key).orderBy("month")
    run = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    z = kpi.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(whole))
    for c in REGIME_METRICS:
        logged = F.log1p(dbl(c))
        dev = F.stddev_pop(logged).over(whole)
        z = z.withColumn(f"z_{c}", F.when(dev > 0, (logged - F.avg(logged).over(whole)) / dev).otherwise(0.0))
    z = materialize(z)  # one row per state and month
    squares = reduce(lambda a, b: a + b, [F.col(f"z_{c}") * F.col(f"z_{c}") for c in REGIME_METRICS])
    prefix = z.select(key, "n", "i", F.sum(squares).over(run).alias("sq"),
                      F.array(*[F.sum(f"z_{c}").over(run) for c in REGIME_METRICS]).alias("s"))
    zero = prefix.where("i = 1").select(key, "n", F.lit(0).alias("i"), F.lit(0.0).alias("sq"),
                                        F.array(*[F.lit(0.0) for _ in REGIME_METRICS]).alias("s"))
    points = prefix.unionByName(zero)
    a = points.select(key, "n", F.col("i").alias("start"), F.col("sq").alias("sq0"), F.col("s").alias("s0"))
    b = points.select(key, F.col("i").alias("end"), F.col("sq").alias("sq1"), F.col("s").alias("s1"))
    inner = reduce(lambda x, y: x + y, [
        (F.col("s1")[d] - F.col("s0")[d]) * (F.col("s1")[d] - F.col("s0")[d]) for d in range(len(REGIME_METRICS))])
    cost = materialize(a.join(b, key).where(F.col("end") - F.col("start") >= min_length).select(
        key, "n", "start", "end",
        (F.col("sq1") - F.col("sq0") - inner / (F.col("end") - F.col("start"))).alias("cost")))
    best = cost.where("start = 0").select(key, "n", "end", F.col("cost").alias("sse"), F.array("end").alias("ends"))
    solutions = [best.where("end = n").withColumn("stages", F.lit(1))]
    for k in range(2, max_stages + 1):
        step = best.select(key, F.col("end").alias("start"), "sse", "ends").join(cost, [key, "start"])
        best = materialize(step.groupBy(key, "n", "end").agg(
            F.min_by(F.struct((F.col("sse") + F.col("cost")).alias("sse"),
                              F.concat("ends", F.array("end")).alias("ends")),
                     F.struct((F.col("sse") + F.col("cost")).alias("v"), F.col("start").alias("at"))).alias("b")).select(
            key, "n", "end", "b.sse", "b.ends"))
        solutions.append(best.where("end = n").withColumn("stages", F.lit(k)))
    dims = len(REGIME_METRICS)
    fit = F.greatest(F.col("sse"), F.lit(2.220446049250313e-16)) / (F.col("n") * dims)
    bic = F.col("n") * dims * F.ln(fit) + (F.col("stages") * dims + F.col("stages") - 1) * F.ln(F.col("n"))
    chosen = (reduce(DataFrame.unionByName, solutions).withColumn("bic", bic).groupBy(key)
              .agg(F.min_by(F.struct("stages", "ends", "bic"), F.struct("bic", "stages")).alias("c")))
    stage = chosen.select(key, F.col("c.stages").alias("stage_count"), F.col("c.bic").alias("bic"),
                          F.posexplode("c.ends").alias("p", "end"), F.col("c.ends").alias("ends")).select(
        key, "stage_count", "bic", (F.col("p") + 1).alias("stage"), "end",
        F.when(F.col("p") == 0, 0).otherwise(F.col("ends")[F.col("p") - 1]).alias("start"))
    rows = stage.join(z.select(key, "i", "month", *REGIME_METRICS), key).where(
        (F.col("i") > F.col("start")) & (F.col("i") <= F.col("end")))
    edge = lambda f, c: f(F.col(c), F.col("i"))
    return rows.groupBy(key, "stage_count", "stage", "bic").agg(
        F.min("month").alias("start_month"), F.max("month").alias("end_month"), F.count("*").alias("observed_months"),
        *[half_up(ratio(F.sum(dbl(c).cast("decimal(28,2)")), F.count("*")), 4).alias(f"{c}_average")
          for c in REGIME_METRICS],
        *[half_up((ratio(edge(F.max_by, c), edge(F.min_by, c)) - 1) * 100, 4).alias(f"{c}_start_end_pct")
          for c in REGIME_METRICS]).select(
        key, F.col("stage_count").cast("bigint").alias("stage_count"), F.col("stage").cast("bigint").alias("stage"),
        "start_month", "end_month", "observed_months",
        *[f"{c}_average" for c in REGIME_METRICS], *[f"{c}_start_end_pct" for c in REGIME_METRICS],
        half_up("bic", 4).alias("bic"))
