"""Recency, frequency and monetary scoring."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from stallkeeper.functions import dbl, exact_mean, flag, literal_rows, materialize, nearest_rank, ratio, scalar, with_values
from stallkeeper.operators.customers import observed_orders
from stallkeeper.sources.model import Commerce

# Segment names in report order.
SEGMENTS = ["重要价值用户", "重要发展用户", "重要保持用户", "重要挽留用户", "一般用户"]
HIGH_VALUE = SEGMENTS[0]
PERCENTILES = {"P20": "0.2", "P40": "0.4", "P60": "0.6", "P80": "0.8"}


def rfm_base(m: Commerce, observation_date: str, orders: DataFrame | None = None) -> DataFrame:
    users = observed_orders(m, observation_date, orders).groupBy("customer_unique_id").agg(
        F.min("purchase_date").alias("first_purchase_date"), F.max("purchase_date").alias("last_purchase_date"),
        F.count("*").alias("frequency"), F.sum("is_paid_order").alias("paid_order_count"),
        F.sum("order_gmv").alias("monetary"),
        F.max(F.struct("order_purchase_timestamp", "order_id", "customer_id", "customer_state", "customer_city"))
        .alias("latest"))
    when = F.lit(observation_date).cast("date")
    return users.select(
        "customer_unique_id", F.col("latest.customer_state").alias("customer_state"),
        F.col("latest.customer_city").alias("customer_city"), "first_purchase_date", "last_purchase_date",
        F.date_diff(when, F.col("last_purchase_date")).cast("bigint").alias("recency_days"),
        "frequency", "paid_order_count", "monetary", flag(F.col("frequency") >= 2).alias("is_repeat_customer"),
        F.col("latest.order_id").alias("latest_order_id"),
        F.col("latest.order_purchase_timestamp").alias("latest_order_purchase_timestamp"),
        F.lit(observation_date).alias("observation_date"))


_LATEST = ("latest_order_id", "latest_order_purchase_timestamp")


def rfm_base_report(m: Commerce, observation_date: str) -> DataFrame:
    return rfm_base(m, observation_date).drop(*_LATEST).withColumn("monetary", dbl("monetary"))


def rfm_boundaries(m: Commerce, observation_date: str, base: DataFrame | None = None) -> DataFrame:
    """Empirical nearest-rank boundaries for recency and monetary value."""
    base = rfm_base(m, observation_date) if base is None else base
    out = []
    for metric, way in (("recency_days", "lower_is_better"), ("monetary", "higher_is_better")):
        q = nearest_rank(base.select(metric), metric, PERCENTILES)
        cells = F.array(*[F.struct(F.lit(n).alias("percentile_label"), F.lit(float(p)).alias("percentile_value"),
                                   F.col(n).alias("boundary_value")) for n, p in PERCENTILES.items()])
        out.append(q.select(F.lit(metric).alias("metric"), F.explode(cells).alias("c")).select(
            "metric", "c.*", F.lit(way).alias("scoring_direction"),
            F.lit("empirical_nearest_rank_on_customer_distribution").alias("boundary_method")))
    return out[0].unionByName(out[1])


def rfm_frequency_map(m: Commerce, observation_date: str, base: DataFrame | None = None) -> DataFrame:
    """Five tiles over the distinct frequencies. Distinct frequencies number at most about the
    square root of twice the orders, so ordering them in one task is safe."""
    base = rfm_base(m, observation_date) if base is None else base
    tiles = base.select("frequency").distinct().withColumn(
        "f_score", F.ntile(5).over(W.partitionBy().orderBy("frequency")).cast("bigint"))
    return tiles.select("frequency", "f_score",
                        F.count("*").over(W.partitionBy("f_score")).alias("distinct_values_in_score"),
                        F.lit("NTILE(5) applied to distinct frequency values only").alias("scoring_method"))


def _score(value, row, names, best_first: bool):
    """Score by the first boundary that is not below the value; absent boundaries never match."""
    out = None
    for i, name in enumerate(names):
        points = 5 - i if best_first else i + 1
        hit = dbl(value) <= row[name]
        out = F.when(hit, points) if out is None else out.when(hit, points)
    return out.otherwise(1 if best_first else 5).cast("bigint")


def rfm_detail(m: Commerce, observation_date: str, high_score: int = 4, orders: DataFrame | None = None) -> DataFrame:
    """Scores, code and segment per user. Boundaries enter as scalar rows: scoring the users is
    a projection without any join (a join on frequency would send all one-order users to one task)."""
    base = materialize(rfm_base(m, observation_date, orders))  # one row per user, read four times
    labels = list(PERCENTILES)
    r = scalar(nearest_rank(base.select("recency_days"), "recency_days", PERCENTILES), *labels)
    mo = scalar(nearest_rank(base.select("monetary"), "monetary", PERCENTILES), *labels)
    tops = rfm_frequency_map(m, observation_date, base).agg(*[
        F.max(F.when(F.col("f_score") == i, dbl("frequency"))).alias(f"F{i}") for i in range(1, 5)])
    f = scalar(tops, "F1", "F2", "F3", "F4")
    scored = base.withColumn("_r", r).withColumn("_m", mo).withColumn("_f", f).select(
        *base.columns, _score("recency_days", F.col("_r"), labels, True).alias("r_score"),
        _score("frequency", F.col("_f"), ["F1", "F2", "F3", "F4"], False).alias("f_score"),
        _score("monetary", F.col("_m"), labels, False).alias("m_score"))
    R, Fq, M = (F.col(c) >= high_score for c in ("r_score", "f_score", "m_score"))
    order = (F.when(R & Fq & M, 1).when(R & ~Fq & M, 2).when(~R & Fq & M, 3).when(~R & ~Fq & M, 4)
             .otherwise(5).cast("bigint"))
    names = F.array(*[F.lit(s) for s in SEGMENTS])
    return (scored.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))
            .withColumn("rfm_code", F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")]))
            .withColumn("rfm_segment_order", order)
            .withColumn("rfm_segment", F.element_at(names, F.col("rfm_segment_order").cast("int"))))


def rfm_detail_report(m: Commerce, observation_date: str) -> DataFrame:
    return rfm_detail(m, observation_date).drop(*_LATEST).withColumn("monetary", dbl("monetary"))


def rfm_score_distribution(m: Commerce, observation_date: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(i).cast("bigint").alias("metric_order"), F.col(c).alias("score"))
                      for i, (n, c) in enumerate((("R", "r_score"), ("F", "f_score"), ("M", "m_score")), 1)])
    counts = (rfm_detail(m, observation_date).select(F.explode(cells).alias("c"))
              .groupBy("c.metric", "c.score").agg(F.count("*").alias("user_count")))
    grid = literal_rows(m.spark, "metric string, metric_order bigint", [("R", 1), ("F", 2), ("M", 3)])
    grid = with_values(grid, "score", [1, 2, 3, 4, 5]).withColumn("score", F.col("score").cast("bigint"))
    out = grid.join(counts, ["metric", "score"], "left").na.fill(0, ["user_count"])
    return out.withColumn("user_share", ratio("user_count", F.sum("user_count").over(W.partitionBy("metric"))))


def rfm_segment_summary(m: Commerce, observation_date: str, detail: DataFrame | None = None) -> DataFrame:
    detail = rfm_detail(m, observation_date) if detail is None else detail
    sums = detail.groupBy("rfm_segment_order", "rfm_segment").agg(
        F.count("*").alias("user_count"), F.sum("frequency").alias("valid_order_count"),
        F.sum("paid_order_count").alias("paid_order_count"), F.sum("monetary").alias("gmv"),
        F.sum("is_repeat_customer").alias("repeat_customer_count"),
        exact_mean("recency_days").alias("average_recency"), exact_mean("frequency").alias("average_frequency"),
        ratio(F.sum("monetary"), F.count("*")).alias("average_monetary"), exact_mean("r_score").alias("average_r_score"),
        exact_mean("f_score").alias("average_f_score"), exact_mean("m_score").alias("average_m_score"))
    grid = literal_rows(m.spark, "rfm_segment_order bigint, rfm_segment string", list(enumerate(SEGMENTS, 1)))
    counts = ["user_count", "valid_order_count", "paid_order_count", "repeat_customer_count"]
    out = grid.join(sums, ["rfm_segment_order", "rfm_segment"], "left").na.fill(0, counts).withColumn(
        "gmv", F.coalesce("gmv", F.lit(0).cast("decimal(38,2)")))
    share = lambda c: ratio(c, F.sum(c).over(W.partitionBy()))  # noqa: E731  five rows
    return out.select(
        "rfm_segment_order", "rfm_segment", *counts, dbl("gmv").alias("gmv"),
        share("user_count").alias("user_share"), share("valid_order_count").alias("order_share"),
        share("gmv").alias("gmv_share"), ratio("gmv", "user_count").alias("spend_per_user"),
        ratio("gmv", "paid_order_count").alias("average_order_value"),
        ratio("gmv", "valid_order_count").alias("gmv_per_valid_order"),
        ratio("valid_order_count", "user_count").alias("average_purchase_frequency"),
        ratio("repeat_customer_count", "user_count").alias("repeat_purchase_rate"),
        "average_recency", "average_frequency", "average_monetary", "average_r_score", "average_f_score",
        "average_m_score")
