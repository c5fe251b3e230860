"""Distances, nearest supply, robust freight lines and the seller scorecard against plain versions."""
from __future__ import annotations

import math
import random

import numpy as np
import pytest
from builders import customer, item, order, review
from pyspark.sql import functions as F

from stallkeeper.operators import freight as FR, sellers as SE


def km(a, b):
    (p, q), (r, s) = a, b
    p, q, r, s = map(math.radians, (p, q, r, s))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


# ---------------------------------------------------------------- places

@pytest.mark.parametrize("seed, spread", [(0, 2.0), (1, 60.0), (2, 180.0)])
def test_nearest_place_equals_all_pairs(spark, seed, spread):
    """Points near the poles, on both sides of the date line, and far from everything."""
    rng = random.Random(seed)

    def points(n, far):
        out = [(rng.uniform(-89.9, 89.9) if far > 90 else rng.uniform(-far, far) / 2 - 20, (rng.uniform(-far, far) + 170 + 180) % 360 - 180)
               for _ in range(n)]
        return {f"{i:05d}": p for i, p in enumerate(out)}

    places, targets = points(60, spread), points(25, min(spread, 30.0) if seed == 1 else spread)
    df = lambda ps: spark.createDataFrame([(k, *v) for k, v in ps.items()], "zip string, lat double, lng double")
    got = {r["zip"]: (r["near_zip"], r["km"]) for r in FR.nearest_place(df(places), df(targets)).collect()}
    want = {z: min((round(km(p, t), 6), k) for k, t in targets.items()) for z, p in places.items()}
    assert set(got) == set(want)
    for z, (d, k) in want.items():
        assert got[z][0] == k and got[z][1] == pytest.approx(d, abs=2e-6)


def test_nearest_place_ties_and_no_targets(spark):
    df = lambda rows: spark.createDataFrame(rows, "zip string, lat double, lng double")
    two = df([("b", 1.0, 1.0), ("a", 1.0, 1.0)])
    assert [tuple(r) for r in FR.nearest_place(df([("x", 1.0, 1.0)]), two).collect()] == [("x", "a", 0.0)]
    assert FR.nearest_place(df([("x", 1.0, 1.0)]), two.limit(0)).collect() == []


def test_no_join_of_all_with_all(spark):
    df = spark.createDataFrame([(f"{i}", float(i % 9), float(i % 7)) for i in range(40)], "zip string, lat double, lng double")
    plan = FR.nearest_place(df, df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def marketplace(commerce, sent):
    """sent: (order, seller, price, freight, handed over after its limit, score); two sellers in two states."""
    orders = {o: order(o, customer=c, order_delivered_carrier_date="2018-01-12 00:00:00" if late else "2018-01-09 00:00:00")
              for o, _, c, _, _, late, _ in sent}
    places = [("01000", -23.5, -46.6), ("20000", -22.9, -43.2)]
    return commerce(
        customers=[customer("c1"), {**customer("c2", state="RJ"), "customer_zip_code_prefix": "20000"},
                   {**customer("c3", state="AM"), "customer_zip_code_prefix": "69000"}],
        geolocation=[{"geolocation_zip_code_prefix": z, "geolocation_lat": a, "geolocation_lng": b} for z, a, b in places]
        + [{"geolocation_zip_code_prefix": "01000", "geolocation_lat": 999.0, "geolocation_lng": 0.0}],
        sellers=[{"seller_id": s, "seller_zip_code_prefix": z, "seller_state": st} for s, z, st in
                 (("s1", "01000", "SP"), ("s2", "20000", "RJ"), ("s3", "01000", "SP"), ("idle", "01000", "SP"))],
        products=[{"product_id": "p1"}], orders=list(orders.values()),
        items=[{**item(o, price=price, freight=fr, seq=i), "seller_id": s} for i, (o, s, _, price, fr, _, _) in enumerate(sent)],
        reviews=[review(o, score, rid=f"r{i}") for i, (o, *_, score) in enumerate(sent) if score])


def test_freight_by_distance(commerce):
    m = marketplace(commerce, [("o1", "s1", "c1", 100, 10, False, 5), ("o2", "s1", "c2", 100, 20, False, 5),
                               ("o2", "s1", "c2", 50, 5, False, None), ("o3", "s2", "c3", 10, 7, True, 1)])
    rows = {(r["origin"], r["destination"]): r for r in FR.freight_by_distance(m).collect()}
    d = km((-23.5, -46.6), (-22.9, -43.2))
    assert rows["SP", "SP"]["distance_band"] == "0-100" and rows["SP", "SP"]["average_km"] == 0
    r = rows["SP", "RJ"]
    assert (r["distance_band"], r["shipment_count"], r["item_count"], r["freight_per_shipment"]) == ("100-500", 1, 2, 25)
    assert r["average_km"] == pytest.approx(d, abs=1e-3) and r["freight_share"] == pytest.approx(25 / 150, abs=1e-6)
    assert (rows["RJ", "AM"]["distance_band"], rows["RJ", "AM"]["average_km"]) == ("unknown", None)
    near = {r["customer_zip"]: r for r in FR.nearest_supply(m).collect()}
    assert near["20000"]["nearest_seller_zip"] == "20000" and near["20000"]["average_km"] == pytest.approx(d, abs=1e-3)
    assert "69000" not in near  # no position


# ---------------------------------------------------------------- robust lines

def plain_huber(x, y, scales=3, rounds=4, tuning=1.345):
    first = w = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(scales):
        scale = 1.4826 * np.sort(np.abs(y - x @ w))[math.ceil(len(y) / 2) - 1]
        for _ in range(rounds):
            q = np.minimum(1, tuning * scale / np.maximum(np.abs(y - x @ w), 1e-300))
            w = np.linalg.solve((x * q[:, None]).T @ x, (x * q[:, None]).T @ y)
    return first, w, scale, int((tuning * scale < np.abs(y - x @ w)).sum())


def test_robust_lines_equal_a_plain_fit(spark):
    rng = np.random.RandomState(5)
    rows, want = [], {}
    for g, weights in (("a", [5, 2, 0.5]), ("b", [1, -1, 3])):
        x = np.c_[np.ones(200), rng.rand(200) * 9, rng.rand(200) * 30]
        y = x @ weights + rng.randn(200) * 0.3
        y[:12] += 500  # a few costly items
        want[g] = plain_huber(x, y)
        assert np.abs(want[g][1] - weights).max() < 1 < 10 < np.abs(want[g][0] - weights).max()
        rows += [(g, *map(float, r), float(v)) for r, v in zip(x, y)]
    rows += [("few", 1.0, float(i), 2.0 + i, 3.0) for i in range(5)] + [("same", 1.0, 2.0, 4.0, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, one double, a double, b double, y double").repartition(5)
    got = {r["g"]: r for r in FR.robust_lines(df, "g", ["one", "a", "b"], "y").collect()}
    for g, (first, last, scale, trimmed) in want.items():
        assert [got[g][f"plain{i}"] for i in range(3)] == pytest.approx(first, abs=1e-8)
        assert [got[g][f"w{i}"] for i in range(3)] == pytest.approx(last, abs=1e-8)
        assert got[g]["scale"] == pytest.approx(scale, abs=1e-8) and got[g]["trimmed_count"] == trimmed
    assert (got["few"]["row_count"], got["few"]["w0"]) == (5, None)
    assert (got["same"]["row_count"], got["same"]["w0"]) == (50, None)


def test_perfect_line_has_no_scale(spark):
    rows = [("a", 1.0, float(i), 2.0 * i + 1) for i in range(40)]
    r = FR.robust_lines(spark.createDataFrame(rows, "g string, one double, a double, y double"), "g", ["one", "a"], "y").first()
    assert (r["w0"], r["w1"]) == (pytest.approx(1, abs=1e-6), pytest.approx(2, abs=1e-6))


# ---------------------------------------------------------------- scorecard

def plain_prior(pairs):
    n, x = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
    p = x.sum() / n.sum()
    between = ((n * (x / n - p) ** 2).sum() - (len(n) - 1) * p * (1 - p)) / (n.sum() - (n ** 2).sum() / n.sum())
    return p, max(0.0, p * (1 - p) / between - 1) if between > 0 else None


def test_prior_and_shrinkage(spark):
    pairs = [(100, 95), (200, 100), (50, 10), (2, 2), (1, 0), (400, 300)]
    df = spark.createDataFrame(pairs, "n long, x long")
    row = df.agg(*SE.prior("n", "x")).first()
    p, strength = plain_prior(pairs)
    assert (row["n_mean"], row["n_strength"]) == (pytest.approx(p), pytest.approx(strength))
    both = df.withColumn("_p", F.struct(F.lit(row["n_mean"]).alias("n_mean"), F.lit(row["n_strength"]).alias("n_strength")))
    rates = {(r["n"], r["x"]): r["r"] for r in both.select("n", "x", SE.shrunk("n", "x", F.col("_p")).alias("r")).collect()}
    assert rates[2, 2] < rates[100, 95] < 0.95  # two of two say less than 95 of 100
    assert all(rates[n, x] == pytest.approx((x + strength * p) / (n + strength)) for n, x in pairs)


def test_sellers_alike_get_the_market_rate(spark):
    row = spark.createDataFrame([(10, 5), (10, 5), (10, 5)], "n long, x long").agg(*SE.prior("n", "x")).first()
    assert (row["n_mean"], row["n_strength"]) == (0.5, None)
    nothing = spark.createDataFrame([(0, 0)], "n long, x long").agg(*SE.prior("n", "x")).first()
    assert (nothing["n_mean"], nothing["n_strength"]) == (None, None)


def test_scorecard(commerce):
    sent = [(f"a{i}", "s1", "c1", 100, 1, i < 2, 5 if i < 18 else 1) for i in range(20)]
    sent += [(f"b{i}", "s2", "c2", 300, 1, i < 15, 1 if i < 15 else 5) for i in range(20)]
    sent += [("c0", "s3", "c1", 10, 1, False, 5)]
    rows = {r["seller_id"]: r for r in SE.seller_scorecard(marketplace(commerce, sent)).collect()}
    assert set(rows) == {"s1", "s2", "s3"}  # a seller without a delivered order has no card
    assert [rows[s]["sales_score"] for s in ("s3", "s1", "s2")] == [0, 50, 100]
    p, strength = plain_prior([(20, 18), (20, 5), (1, 1)])
    assert rows["s3"]["on_time_rate"] == 1 and rows["s3"]["shrunk_on_time_rate"] == pytest.approx((1 + strength * p) / (1 + strength), abs=1e-6)
    assert rows["s3"]["shrunk_on_time_rate"] < rows["s1"]["shrunk_on_time_rate"] or strength < 1
    for r in rows.values():
        assert r["score"] == pytest.approx(0.4 * r["sales_score"] + 0.3 * r["dispatch_score"] + 0.3 * r["service_score"], abs=2e-4)
    assert {r["grade"]: r["seller_count"] for r in SE.seller_grade_summary(marketplace(commerce, sent)).collect()}
