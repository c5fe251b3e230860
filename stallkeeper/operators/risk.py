"""Churn warning: a logistic score of who will not buy again, its ranking quality, and the users most at risk."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from stallkeeper.functions import counted_ranks, dbl, flag, global_rank, half_up, literal_rows, materialize
from stallkeeper.functions.fitting import Scale, linear, logistic, scale
from stallkeeper.operators.churn import order_experience
from stallkeeper.operators.customers import customer_order_base
from stallkeeper.sources.model import Commerce

FEATURES = ["log_recency", "log_orders", "log_gmv", "late_share", "average_score", "no_score"]
NEUTRAL_SCORE = 3.0  # stands for a user without any review, who is marked by ``no_score`` besides


def risk_features(m: Commerce, cutoff: str) -> DataFrame:
    """What is known of each user on the cutoff day, from one aggregate over the orders up to it."""
    log1 = lambda c: F.ln(F.lit(1.0) + c)
    scores = F.count("review_score")
    late = F.count("is_delayed")
    return order_experience(m, cutoff).groupBy("customer_unique_id").agg(
        log1(F.date_diff(F.lit(cutoff).cast("date"), F.to_date(F.max("order_purchase_timestamp")))).alias("log_recency"),
        log1(F.count("*")).alias("log_orders"), log1(dbl(F.sum("order_gmv"))).alias("log_gmv"),
        F.coalesce(F.try_divide(dbl(F.sum("is_delayed")), dbl(late)), F.lit(0.0)).alias("late_share"),
        F.coalesce(F.try_divide(dbl(F.sum("review_score")), dbl(scores)), F.lit(NEUTRAL_SCORE)).alias("average_score"),
        F.when(scores == 0, 1.0).otherwise(0.0).alias("no_score"))


def held_out(user: str):
    """A fifth of all users, the same in every run."""
    return F.conv(F.substring(F.md5(F.col(user).cast("string")), 1, 8), 16, 10).cast("bigint") % 5 == 0


@dataclass
class RiskModel:
    """Weights over standard scores of the features; the first weight is the constant's."""
    scale: Scale
    weights: list[float]
    labelled: DataFrame

    def score(self, users: DataFrame) -> DataFrame:
        """Adds ``risk``, the probability of no purchase within the horizon, rounded so that equal users tie."""
        x = [F.lit(1.0), *self.scale.scores([F.col(f) for f in FEATURES])]
        return users.withColumn("risk", half_up(F.lit(1.0) / (F.lit(1.0) + F.exp(-linear(x, self.weights))), 9))


def fit(m: Commerce, cutoff: str, horizon: int = 90, penalty: float = 1.0) -> RiskModel:
    """Learn from users known at the cutoff who, by the days after it, churned (label 1: no purchase within
    ``horizon`` days) or not. A fifth of the users is held out of means, deviations and weights."""
    end = F.date_add(F.lit(cutoff).cast("date"), horizon)
    later = customer_order_base(m).where((F.col("purchase_date") > F.lit(cutoff).cast("date")) & (F.col("purchase_date") <= end))
    later = later.select("customer_unique_id").distinct().withColumn("_back", F.lit(1))
    labelled = materialize(risk_features(m, cutoff).join(later, "customer_unique_id", "left").withColumn(
        "churned", flag(F.col("_back").isNull())).withColumn("held_out", held_out("customer_unique_id")).drop("_back"))
    train = labelled.where(~F.col("held_out"))
    by = scale(train, [F.col(f) for f in FEATURES])
    x = [F.lit(1.0), *by.scores([F.col(f) for f in FEATURES])]
    return RiskModel(by, [float(w) for w in logistic(train, x, F.col("churned"), penalty)], labelled)


def churn_risk_model(m: Commerce, cutoff: str, horizon: int = 90) -> DataFrame:
    """The fitted weights, per deviation of a feature, with their odds ratios."""
    model = fit(m, cutoff, horizon)
    rows = [("constant", 0, None, None, model.weights[0])] + [
        (f, i + 1, model.scale.means[i], model.scale.deviations[i], model.weights[i + 1]) for i, f in enumerate(FEATURES)]
    table = literal_rows(m.spark, "feature string, place bigint, mean double, deviation double, weight double", rows)
    return table.select("feature", "place", *[half_up(c, 6).alias(c) for c in ("mean", "deviation", "weight")],
                        half_up(F.exp("weight"), 6).alias("odds_ratio"))


def churn_risk_quality(m: Commerce, cutoff: str, horizon: int = 90, top: float = 0.1) -> DataFrame:
    """How well the score ranks the users held out: ``ranking_quality`` is the probability that a user who churned
    scores above one who did not (ties count half), from the ranks of the scores; and the churn rate among the top."""
    model = fit(m, cutoff, horizon)
    tested = materialize(model.score(model.labelled.where("held_out")).select("customer_unique_id", "churned", "risk"))
    placed = global_rank(tested.withColumn("_down", -F.col("risk")), [], "_down", "customer_unique_id", "_place")
    placed = placed.join(counted_ranks(tested, "risk").select("risk", "average_rank"), "risk")
    y, first = F.col("churned"), F.col("_place") <= F.ceil(F.lit(top) * F.col("n"))
    bad, all_ = dbl(F.sum(y)), dbl(F.count("*"))
    rate = bad / all_
    top_rate = F.avg(F.when(first, dbl(y)))
    return placed.agg(
        F.count("*").alias("user_count"), F.coalesce(F.sum(y), F.lit(0)).alias("churned_count"), half_up(rate, 6).alias("churn_rate"),
        half_up(F.try_divide(F.sum(F.col("average_rank") * y) - bad * (bad + 1) / 2, bad * (all_ - bad)), 6).alias("ranking_quality"),
        F.count(F.when(first, 1)).alias("top_count"), half_up(top_rate, 6).alias("top_churn_rate"),
        half_up(F.try_divide(top_rate, rate), 6).alias("top_lift"),
        half_up(F.avg((F.col("risk") - y) * (F.col("risk") - y)), 6).alias("squared_error"))


def churn_risk_users(m: Commerce, cutoff: str, observation_date: str, horizon: int = 90, top: float = 0.1) -> DataFrame:
    """The ``top`` share of users most at risk on the observation day, by the model learnt at the cutoff."""
    model = fit(m, cutoff, horizon)
    scored = materialize(model.score(risk_features(m, observation_date)).withColumn("_down", -F.col("risk")))
    ranked = global_rank(scored, [], "_down", "customer_unique_id", "risk_rank")
    back = lambda c: F.round(F.exp(c) - 1).cast("bigint")
    return ranked.where(F.col("risk_rank") <= F.ceil(F.lit(top) * F.col("n"))).select(
        "customer_unique_id", "risk_rank", half_up("risk", 6).alias("risk"), back("log_recency").alias("recency_days"),
        back("log_orders").alias("valid_order_count"), half_up(F.exp("log_gmv") - 1, 2).alias("lifetime_gmv"))
