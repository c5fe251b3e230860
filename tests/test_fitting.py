"""Fits by repeated sums against plain versions on the same rows."""
from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallkeeper.functions import counted_ranks
from stallkeeper.functions.fitting import k_means, least_squares, logistic, nearest_centre, scale


def cols(*names):
    return [F.col(n) for n in names]


# ---------------------------------------------------------------- k-means

def plain_k_means(points, k, rounds=15):
    """points: {key: tuple}; the same seeds, the same rounds."""
    far = lambda p, cs: min(sum((float(a) - b) ** 2 for a, b in zip(p, c)) for c in cs)
    first = min(points, key=lambda x: (-points[x][0], x))
    centres = [tuple(map(float, points[first]))]
    while len(centres) < k:
        best = min(points, key=lambda x: (-far(points[x], centres), x))
        if far(points[best], centres) == 0:
            break
        centres.append(tuple(map(float, points[best])))
    for _ in range(rounds):
        own = {i: [] for i in range(len(centres))}
        for p in points.values():
            own[min(range(len(centres)), key=lambda i: (far(p, [centres[i]]), i))].append(p)
        moved = [tuple(float(sum(v)) / len(ps) for v in zip(*ps)) if ps else c for c, ps in zip(centres, own.values())]
        if moved == centres:
            break
        centres = moved
    return centres


@pytest.mark.parametrize("seed", range(3))
def test_k_means_equals_plain_rounds(spark, seed):
    rng = random.Random(seed)
    points = {i: tuple(int(rng.gauss(rng.choice([-4, 0, 5]), 1) * 1e6) for _ in range(3)) for i in range(150)}
    df = spark.createDataFrame([(k, *v) for k, v in points.items()], "key long, a long, b long, c long").repartition(5)
    centres = k_means(df, "key", ["a", "b", "c"], 4)
    assert centres == plain_k_means(points, 4)
    near = {r["key"]: r["n"]["i"] for r in df.select("key", nearest_centre(["a", "b", "c"], centres).alias("n")).collect()}
    assert len(set(near.values())) == 4


def test_k_means_odd_input(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "key long, a long")
    assert k_means(df, "key", ["a"], 4) == [(5.0,)]  # no four different points
    assert k_means(df.limit(0), "key", ["a"], 4) == []
    two = spark.createDataFrame([(1, 0), (2, 10), (3, 11)], "key long, a long")
    assert k_means(two, "key", ["a"], 2) == [(10.5,), (0.0,)]


# ---------------------------------------------------------------- regression

def rows_of(spark, x, y):
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)],
                                 ", ".join(f"x{i} double" for i in range(x.shape[1])) + ", y double").repartition(3)


def test_least_squares(spark):
    rng = np.random.RandomState(0)
    x = np.c_[np.ones(80), rng.randn(80, 2)]
    y = x @ [3.0, -1.5, 0.5] + rng.randn(80)
    fit = least_squares(rows_of(spark, x, y), cols("x0", "x1", "x2"), F.col("y"))
    want, left, _, _ = np.linalg.lstsq(x, y, rcond=None)
    assert fit.weights == pytest.approx(want, abs=1e-10)
    assert fit.deviation == pytest.approx(np.sqrt(left[0] / 77), abs=1e-10)
    new = np.array([1.0, 0.3, -2.0])
    row = spark.createDataFrame([tuple(map(float, new))], "x0 double, x1 double, x2 double").select(
        fit.at(cols("x0", "x1", "x2")).alias("y"), fit.spread(cols("x0", "x1", "x2")).alias("s")).first()
    assert row["y"] == pytest.approx(new @ want, abs=1e-10)
    assert row["s"] == pytest.approx(np.sqrt(left[0] / 77 * (1 + new @ np.linalg.inv(x.T @ x) @ new)), abs=1e-10)


def test_least_squares_says_what_it_cannot_do(spark):
    x = np.c_[np.ones(6), np.arange(6), 2 * np.arange(6)]
    with pytest.raises(ValueError, match="depend"):
        least_squares(rows_of(spark, x, np.arange(6)), cols("x0", "x1", "x2"), F.col("y"))
    with pytest.raises(ValueError, match="rows"):
        least_squares(rows_of(spark, x[:2], np.arange(2)), cols("x0", "x1"), F.col("y"))


def plain_logistic(x, y, penalty):
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


@pytest.mark.parametrize("penalty", [0.0, 1.0])
def test_logistic_equals_plain_solver(spark, penalty):
    rng = np.random.RandomState(1)
    x = np.c_[np.ones(300), rng.randn(300, 3)]
    y = (rng.rand(300) < 1 / (1 + np.exp(-x @ [0.5, 1.0, -2.0, 0.0]))).astype(float)
    got = logistic(rows_of(spark, x, y), cols("x0", "x1", "x2", "x3"), F.col("y"), penalty)
    assert got == pytest.approx(plain_logistic(x, y, penalty), abs=1e-8)


def test_logistic_with_separable_labels(spark):
    x = np.c_[np.ones(20), np.arange(20) - 9.5]
    got = logistic(rows_of(spark, x, np.arange(20) > 9), cols("x0", "x1"), F.col("y"), 1.0)
    assert got == pytest.approx(plain_logistic(x, (np.arange(20) > 9).astype(float), 1.0), abs=1e-8)


def test_scale_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    s = scale(df, cols("a", "b"))
    assert (s.means, s.deviations) == ([2.0, 4.0], [1.0, 0.0])
    assert [tuple(r) for r in df.select(*s.scores(cols("a", "b"))).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


# ---------------------------------------------------------------- ranks

@pytest.mark.parametrize("values", [
    [], [None, None], [3], [5, 5, 5, None], list(range(50)), [0, -1, 1, -1, 10 ** 15, 10 ** 15 + 1, 10 ** 15 + 1, -10 ** 9]])
def test_counted_ranks(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    have = sorted(v for v in values if v is not None)
    want = {v: (have.count(v), sum(i + 1 for i, x in enumerate(have) if x == v) / have.count(v)) for v in have}
    assert {r["v"]: (r["n"], r["average_rank"]) for r in counted_ranks(df, "v").collect()} == want


def test_counted_ranks_of_doubles(spark):
    rng = random.Random(2)
    values = [round(rng.gauss(0, 1000), 2) for _ in range(3000)] + [0.0] * 40
    got = {r["v"]: (r["n"], r["average_rank"]) for r in counted_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()}
    have = sorted(values)
    first, last = {}, {}
    for i, v in enumerate(have, 1):
        first.setdefault(v, i)
        last[v] = i
    assert got == {v: (last[v] - first[v] + 1, (first[v] + last[v]) / 2) for v in first}
