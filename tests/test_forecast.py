"""Forecast and attribution on hand-made days."""
from __future__ import annotations

import math
import statistics
from datetime import date, timedelta

import numpy as np
import pytest
from builders import SELLER, customer, item, order, payment

from stallkeeper.operators import forecast as FC

DAY = date(2017, 1, 2)
HOLIDAYS = [("Sale", 2017, str(DAY + timedelta(60)), str(DAY + timedelta(61)))]


def shop(commerce, amounts):
    """One paid and delivered order a day with the given revenue; days with 0 have none."""
    days = [(i, a) for i, a in enumerate(amounts) if a]
    return commerce(customers=[customer("c1")], sellers=SELLER, products=[{"product_id": "p1"}],
                    orders=[order(f"o{i}", bought=f"{DAY + timedelta(i)} 10:00:00") for i, _ in days],
                    payments=[payment(f"o{i}", a) for i, a in days])


def test_forecast_equals_plain_least_squares(commerce):
    rng = np.random.RandomState(3)
    season = FC.Season(weekly=1, yearly=1)
    amounts = [round(float(500 + 2 * i + 50 * math.sin(2 * math.pi * i / 7) + rng.randn() * 5 + (300 if i in (60, 61) else 0)), 2)
               for i in range(120)]
    amounts[33] = 0
    target = [("Sale", 2017, str(DAY + timedelta(110)), str(DAY + timedelta(111))), ("Sale", 2018, "2018-03-03", "2018-03-03")]
    got = {r["forecast_date"]: r for r in FC.holiday_forecast(
        shop(commerce, amounts), HOLIDAYS, target, str(DAY + timedelta(99)), season).collect()}
    epoch = (DAY - date(1970, 1, 1)).days

    def x(i, special):
        n = epoch + i
        return [1.0, i / 365.25, *(f(2 * math.pi * n / p) for p in (7.0, 365.25) for f in (math.sin, math.cos)), float(special)]

    a, y = np.array([x(i, i in (60, 61)) for i in range(100)]), np.array(amounts[:100])
    w, left, _, _ = np.linalg.lstsq(a, y, rcond=None)
    for day, i in ((DAY + timedelta(110), 110), (DAY + timedelta(111), 111), (date(2018, 3, 3), (date(2018, 3, 3) - DAY).days)):
        v = np.array(x(i, True))
        s = math.sqrt(left[0] / 93 * (1 + v @ np.linalg.inv(a.T @ a) @ v))
        r = got[day]
        assert r["forecast_gmv"] == pytest.approx(v @ w, abs=0.011)
        assert r["ordinary_gmv"] == pytest.approx(v @ w - w[-1], abs=0.011)
        assert r["upper_gmv"] - r["forecast_gmv"] == pytest.approx(1.959963984540054 * s, abs=0.02)
        assert r["actual_gmv"] == (pytest.approx(amounts[i]) if i < 120 else None)
        assert r["is_inside"] == (None if i >= 120 else int(abs(amounts[i] - v @ w) <= 1.959963984540054 * s))


def test_forecast_needs_a_holiday_to_learn_from(commerce):
    with pytest.raises(ValueError, match="depend"):
        FC.holiday_forecast(shop(commerce, [10.0 + i for i in range(50)]), HOLIDAYS, HOLIDAYS, "2017-02-15",
                            FC.Season(1, 0)).collect()


def attributed(spark, rows, days=(4, 2)):
    """rows: (phase, day, group, y); phases of 4 and 2 days."""
    first = date(2017, 5, 1)
    daily = spark.createDataFrame([("H", 2017, p, first + timedelta(d), g, float(y)) for p, d, g, y in rows],
                                  "holiday_name string, year bigint, phase int, order_date date, g string, y double")
    windows = spark.createDataFrame([("H", 2017, p, n, first + timedelta(d)) for p, n in enumerate(days) for d in range(n)],
                                    "holiday_name string, year bigint, phase int, days int, order_date date")
    return {r["g"]: r for r in FC.differences(daily, windows, "g").collect()}


def test_effect_of_a_hand_worked_holiday(spark):
    # a: 10, 12, 8, 10 (mean 10), then 30 and 34. The others: 20, 20, 24, 16 (mean 20), then 22 and 26.
    rows = [(0, d, "a", v) for d, v in enumerate([10, 12, 8, 10])] + [(1, 4 + d, "a", v) for d, v in enumerate([30, 34])]
    rows += [(0, d, "b", v) for d, v in enumerate([15, 15, 20, 10])] + [(1, 4 + d, "b", v) for d, v in enumerate([20, 20])]
    rows += [(0, d, "c", v) for d, v in enumerate([5, 5, 4, 6])] + [(1, 4 + d, "c", v) for d, v in enumerate([2, 6])]
    r = attributed(spark, rows)["a"]
    # The control halved: 10, 10, 12, 8, then 11 and 13; expected 12 a day, sold 32.
    gaps = [[0, 2, -4, 2], [19, 21]]
    error = math.sqrt(sum(statistics.variance(g) / len(g) for g in gaps))
    assert (r["baseline_daily"], r["window_daily"], r["expected_daily"], r["effect_daily"], r["effect_total"]) == (10, 32, 12, 20, 40)
    assert r["std_error"] == round(error, 2) and r["t_value"] == round(20 / error, 4) and r["lift"] == pytest.approx(20 / 12, abs=1e-6)


def test_missing_days_count_as_zero_and_lone_groups_have_no_effect(spark):
    rows = [(0, 0, "a", 8), (1, 4, "a", 10), (0, 1, "b", 4), (1, 5, "b", 2)]
    r = attributed(spark, rows)["a"]
    assert (r["baseline_daily"], r["window_daily"], r["expected_daily"]) == (2, 5, 2)  # twice the control's 1 a day
    gaps = [[8, -8, 0, 0], [10, -4]]
    assert r["std_error"] == round(math.sqrt(sum(statistics.variance(g) / len(g) for g in gaps)), 2)
    lone = attributed(spark, [(0, 0, "a", 8), (1, 4, "a", 10)])["a"]
    assert (lone["window_daily"], lone["effect_daily"], lone["std_error"], lone["lift"]) == (5, None, None, None)
    single = attributed(spark, [(0, 0, "a", 8), (1, 4, "a", 10), (0, 0, "b", 8), (1, 4, "b", 8)], days=(4, 1))["a"]
    assert (single["effect_daily"], single["std_error"]) == (2, None)


def test_user_tiers_by_what_was_spent_before(commerce):
    first = DAY + timedelta(60)
    users = {"new": [], "low": [100], "middle": [150, 60], "high": [5000]}
    orders, payments = [], []
    for u, spent in users.items():
        for k, a in enumerate(spent):
            orders.append(order(f"{u}{k}", customer=u, bought=f"{DAY} 09:00:00"))
            payments.append(payment(f"{u}{k}", a))
        for k, offset in enumerate((-3, 1)):
            orders.append(order(f"{u}x{k}", customer=u, bought=f"{first + timedelta(offset)} 09:00:00"))
            payments.append(payment(f"{u}x{k}", 70))
    m = commerce(customers=[customer(u) for u in users], orders=orders, payments=payments)
    rows = {r["user_tier"]: r for r in FC.holiday_by_user_tier(m, HOLIDAYS).collect()}
    assert set(rows) == set(users)
    # All spent 70 in the 28 days before and 70 in the 8 days from the holiday on, so nothing is special.
    assert all((r["baseline_daily"], r["window_daily"], r["effect_daily"]) == (2.5, 8.75, 0.0) for r in rows.values())


def test_category_effect_from_orders(commerce):
    first = DAY + timedelta(60)
    orders, items = [], []
    for p, (before, during) in {"p1": (4, 30), "p2": (8, 16)}.items():
        for kind, price, offset in (("b", before, -5), ("d", during, 0)):
            orders.append(order(f"{p}{kind}", bought=f"{first + timedelta(offset)} 09:00:00"))
            items.append(item(f"{p}{kind}", product=p, price=price))
    m = commerce(customers=[customer("c1")], sellers=SELLER, orders=orders, items=items,
                 products=[{"product_id": "p1", "product_category_name": "x"}, {"product_id": "p2", "product_category_name": "y"}],
                 translation=[{"product_category_name": c, "product_category_name_english": c} for c in "xy"])
    r = {x["category_name"]: x for x in FC.holiday_by_category(m, HOLIDAYS, before=4 + 1, after=0).collect()}
    assert (r["x"]["window_daily"], r["x"]["expected_daily"], r["x"]["effect_total"]) == (15, 4, 22)
