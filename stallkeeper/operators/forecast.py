"""Holiday forecast by seasonal least squares, and attribution of a holiday's sales to groups by differences."""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper.functions import calendar, dbl, flag, half_up, literal_rows, materialize, ratio, scalar
from stallkeeper.functions.fitting import Line, least_squares
from stallkeeper.operators.category import category_items
from stallkeeper.operators.kpi import daily_kpi, paid_user_orders
from stallkeeper.sources.model import Commerce

HOLIDAY = "holiday_name string, year bigint, first date, last date"
Z95 = 1.959963984540054


# ---------------------------------------------------------------- forecast

@dataclass
class Season:
    """Constant, trend by year, weekly and yearly waves, and whether a day belongs to a holiday."""
    weekly: int = 2
    yearly: int = 2

    def names(self) -> list[str]:
        waves = [f"{kind}_{f}_{k}" for kind, n in (("week", self.weekly), ("year", self.yearly))
                 for k in range(1, n + 1) for f in ("sin", "cos")]
        return ["constant", "trend", *waves, "holiday"]

    def columns(self, day: Column, is_holiday: Column, origin: Column) -> list[Column]:
        number = dbl(F.unix_date(day))
        out = [F.lit(1.0), (number - dbl(F.unix_date(origin))) / 365.25]
        for period, n in ((7.0, self.weekly), (365.25, self.yearly)):
            for k in range(1, n + 1):
                angle = number * F.lit(2 * math.pi * k / period)
                out += [F.sin(angle), F.cos(angle)]
        return [*out, dbl(flag(is_holiday))]


def daily_series(m: Commerce, holidays: Sequence[tuple], last: str | None = None) -> DataFrame:
    """One row per calendar day from the first day with sales on: revenue (0 on days without) and whether the day
    belongs to a holiday. ``last`` ends the series; else the last day with sales does."""
    daily = materialize(daily_kpi(m).select("order_date", "gmv"))
    span = scalar(daily.agg(F.min("order_date").alias("first"), F.max("order_date").alias("last")), "first", "last")
    days = calendar(m.spark, span["first"], span["last"], "day", "order_date").withColumn("origin", span["first"])
    if last is not None:
        days = days.where(F.col("order_date") <= F.lit(last).cast("date"))
    marked = literal_rows(m.spark, HOLIDAY, holidays).select(
        F.explode(F.sequence("first", "last")).alias("order_date")).distinct().withColumn("_holiday", F.lit(1))
    return (days.join(daily, "order_date", "left").join(marked, "order_date", "left")
            .select("order_date", "origin", F.coalesce("gmv", F.lit(0.0)).alias("gmv"),
                    F.col("_holiday").isNotNull().alias("is_holiday")))


def _fit(m: Commerce, holidays: Sequence[tuple], cutoff: str, season: Season) -> tuple[Line, DataFrame]:
    series = materialize(daily_series(m, holidays))
    past = series.where(F.col("order_date") <= F.lit(cutoff).cast("date"))
    x = season.columns(F.col("order_date"), F.col("is_holiday"), F.col("origin"))
    return least_squares(past, x, F.col("gmv")), series


def holiday_forecast_model(m: Commerce, holidays: Sequence[tuple], cutoff: str, season: Season = Season()) -> DataFrame:
    """Weights of the daily model with their standard errors and t values."""
    line, _ = _fit(m, holidays, cutoff, season)
    errors = [line.deviation * math.sqrt(line.inverse[i, i]) for i in range(len(line.weights))]
    rows = [(n, i, float(w), e, line.n) for i, (n, w, e) in enumerate(zip(season.names(), line.weights, errors))]
    table = literal_rows(m.spark, "feature string, place bigint, weight double, std_error double, day_count bigint", rows)
    return table.select("feature", "place", half_up("weight", 2).alias("weight"), half_up("std_error", 2).alias("std_error"),
                        half_up(ratio("weight", "std_error"), 4).alias("t_value"), "day_count")


def holiday_forecast(m: Commerce, holidays: Sequence[tuple], targets: Sequence[tuple], cutoff: str,
                     season: Season = Season()) -> DataFrame:
    """Forecast revenue of the days of ``targets`` (name, year, first day, last day) from the days up to the cutoff:
    with the holiday's weight, without it (``ordinary_gmv``), a 95 percent interval for a single day, and, where the
    day has passed, what it brought. Revenue cannot be negative, so the interval starts at 0."""
    line, series = _fit(m, holidays, cutoff, season)
    origin = scalar(series.agg(F.min("origin").alias("o")), "o")["o"]
    days = literal_rows(m.spark, HOLIDAY, targets).withColumn("order_date", F.explode(F.sequence("first", "last")))
    days = days.withColumn("origin", origin)
    x = season.columns(F.col("order_date"), F.lit(True), F.col("origin"))
    plain = season.columns(F.col("order_date"), F.lit(False), F.col("origin"))
    actual = series.select("order_date", F.col("gmv").alias("actual"))
    rows = days.select("holiday_name", "year", "order_date", line.at(x).alias("y"), line.at(plain).alias("ordinary"),
                       line.spread(x).alias("s")).join(actual, "order_date", "left")
    low = F.greatest(F.lit(0.0), F.col("y") - F.lit(Z95) * F.col("s"))
    high = F.col("y") + F.lit(Z95) * F.col("s")
    return rows.select(
        "holiday_name", "year", F.col("order_date").alias("forecast_date"), half_up("y", 2).alias("forecast_gmv"),
        half_up("ordinary", 2).alias("ordinary_gmv"), half_up(low, 2).alias("lower_gmv"), half_up(high, 2).alias("upper_gmv"),
        half_up("actual", 2).alias("actual_gmv"),
        F.when(F.col("actual").isNotNull(), flag(F.col("actual").between(low, high))).alias("is_inside"))


# ---------------------------------------------------------------- attribution

def _windows(m: Commerce, holidays: Sequence[tuple], before: int, after: int) -> DataFrame:
    """Days of each holiday's baseline (``before`` days) and window (the holiday and ``after`` days), with the number
    of days of the phase."""
    h = literal_rows(m.spark, HOLIDAY, holidays)
    phases = F.array(F.struct(F.lit(0).alias("phase"), F.date_sub("first", before).alias("a"), F.date_sub("first", 1).alias("b")),
                     F.struct(F.lit(1).alias("phase"), F.col("first").alias("a"), F.date_add("last", after).alias("b")))
    rows = h.select("holiday_name", "year", F.explode(phases).alias("w")).select("holiday_name", "year", "w.*")
    return rows.select("holiday_name", "year", "phase", (F.date_diff("b", "a") + 1).alias("days"),
                       F.explode(F.sequence("a", "b")).alias("order_date"))


def differences(daily: DataFrame, windows: DataFrame, group: str) -> DataFrame:
    """Difference in differences per holiday and group from daily sums (holiday_name, year, phase, order_date, group,
    y; days without sales may be missing).

    All other groups are the control, scaled to the group's own baseline, so that both start level. Effect: what the
    group sold a day in the window beyond the scaled control. Its standard error comes from the daily gaps in both
    phases. Everything is built from sums of y, y squared, the day's total T, T squared and y T, so a group is merged
    map-side. Without control sales in the baseline there is no effect; with a single day in a phase, no error.
    """
    keys = ["holiday_name", "year"]
    length = windows.groupBy(*keys).agg(*[F.max(F.when(F.col("phase") == p, F.col("days"))).alias(f"n{p}") for p in (0, 1)])
    totals = daily.groupBy(*keys, "phase", "order_date").agg(F.sum("y").alias("t"))
    both = daily.join(totals, [*keys, "phase", "order_date"])
    at = lambda p, c: F.coalesce(F.sum(F.when(F.col("phase") == p, c)), F.lit(0.0))
    y, t = F.col("y"), F.col("t")
    own = both.groupBy(*keys, group).agg(*[at(p, c).alias(f"{n}{p}") for p in (0, 1) for n, c in (
        ("y", y), ("yy", y * y), ("yt", y * t))])
    every = totals.groupBy(*keys).agg(*[at(p, c).alias(f"{n}{p}") for p in (0, 1) for n, c in (("t", t), ("tt", t * t))])
    rows = own.join(every, keys).join(length, keys).withColumn("k", F.try_divide(F.col("y0"), F.col("t0") - F.col("y0")))
    k = F.col("k")

    def spread(p: int) -> Column:
        """Variance of the mean daily gap z = (1 + k) y - k t."""
        n = F.col(f"n{p}")
        z = (1 + k) * F.col(f"y{p}") - k * F.col(f"t{p}")
        zz = (1 + k) * (1 + k) * F.col(f"yy{p}") - 2 * k * (1 + k) * F.col(f"yt{p}") + k * k * F.col(f"tt{p}")
        return F.when((n > 1) & k.isNotNull(), F.greatest(F.lit(0.0), zz - z * z / n) / ((n - 1) * n))

    expected = k * (F.col("t1") - F.col("y1")) / F.col("n1")
    sold = F.col("y1") / F.col("n1")
    error = F.sqrt(spread(0) + spread(1))
    return rows.select(
        *keys, group, F.col("n0").cast("bigint").alias("baseline_days"), F.col("n1").cast("bigint").alias("window_days"),
        half_up(F.col("y0") / F.col("n0"), 2).alias("baseline_daily"), half_up(sold, 2).alias("window_daily"),
        half_up(expected, 2).alias("expected_daily"), half_up(sold - expected, 2).alias("effect_daily"),
        half_up(error, 2).alias("std_error"), half_up(F.try_divide(sold - expected, error), 4).alias("t_value"),
        half_up((sold - expected) * F.col("n1"), 2).alias("effect_total"),
        half_up(F.try_divide(sold - expected, expected), 6).alias("lift"))


def holiday_by_category(m: Commerce, holidays: Sequence[tuple], before: int = 28, after: int = 6) -> DataFrame:
    """Effect of each holiday on the daily item sales of each category."""
    windows = _windows(m, holidays, before, after)
    items = category_items(m).groupBy(F.to_date("purchase_timestamp").alias("order_date"), "category_name").agg(
        dbl(F.sum("price")).alias("y"))
    return differences(materialize(items.join(windows, "order_date")), windows, "category_name")


def holiday_by_user_tier(m: Commerce, holidays: Sequence[tuple], bounds: Sequence[float] = (200, 1000),
                         before: int = 28, after: int = 6) -> DataFrame:
    """Effect of each holiday on the daily revenue of each user tier: what a user had spent before the baseline began
    (nothing: new; below the first bound: low; below the second: middle; else high)."""
    windows = materialize(_windows(m, holidays, before, after))
    starts = windows.groupBy("holiday_name", "year").agg(F.min("order_date").alias("start"), F.max("order_date").alias("end"))
    days = materialize(paid_user_orders(m).groupBy("customer_unique_id", F.to_date("order_purchase_timestamp").alias("order_date"))
                       .agg(F.sum("amount").alias("amount")))
    packed = scalar(starts.agg(F.collect_list(F.struct("holiday_name", "year", "start", "end")).alias("h")), "h")["h"]
    # The holidays are a short list, so each user-day is unfolded by those that it comes before or in.
    tagged = days.withColumn("_all", packed).select("*", F.explode("_all").alias("h")).drop("_all").where(
        F.col("order_date") <= F.col("h.end"))
    past = F.col("order_date") < F.col("h.start")
    by_user = ["h.holiday_name", "h.year", "customer_unique_id"]
    spent = tagged.groupBy(*by_user).agg(F.sum(F.when(past, F.col("amount"))).alias("spent"))
    low, high = (F.lit(b) for b in bounds)
    tier = (F.when(F.col("spent").isNull(), "new").when(F.col("spent") < low, "low").when(F.col("spent") < high, "middle")
            .otherwise("high"))
    inside = tagged.where(~past).select(*by_user, "order_date", "amount")
    sums = (inside.join(spent, ["holiday_name", "year", "customer_unique_id"]).groupBy(
        "holiday_name", "year", "order_date", tier.alias("user_tier")).agg(dbl(F.sum("amount")).alias("y")))
    return differences(materialize(sums.join(windows, ["holiday_name", "year", "order_date"])), windows, "user_tier")
