"""Models fitted by repeated sums.

The rows stay where they are: each round is one aggregate over them, and what reaches the driver is a matrix of the
size of the features or a table of the size of the centres. Callers store the rows first (``materialize``), so that a
round reads only the columns of the model.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper.functions.core import dbl


def linear(x: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted sum of columns, in the order given."""
    return reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(x, weights)])


def _square(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _symmetric(k: int, values: Sequence[float]) -> np.ndarray:
    a = np.zeros((k, k))
    for (i, j), v in zip(_square(k), values):
        a[i, j] = a[j, i] = v
    return a


# ---------------------------------------------------------------- standard scores

@dataclass
class Scale:
    """Mean and population deviation of each feature; a constant feature has deviation 0 and scores 0."""
    means: list[float]
    deviations: list[float]

    def scores(self, x: Sequence[Column]) -> list[Column]:
        return [(c - F.lit(m)) / F.lit(s) if s else F.lit(0.0) for c, m, s in zip(x, self.means, self.deviations)]


def scale(df: DataFrame, x: Sequence[Column]) -> Scale:
    row = df.agg(*[f(c) for c in x for f in (F.avg, F.stddev_pop)]).first()
    return Scale([float(v or 0) for v in row[::2]], [float(v or 0) for v in row[1::2]])


# ---------------------------------------------------------------- least squares

@dataclass
class Line:
    """A least squares fit: weights, the inverse of the cross products, residual deviation and row count."""
    weights: np.ndarray
    inverse: np.ndarray
    deviation: float
    n: int

    def at(self, x: Sequence[Column]) -> Column:
        return linear(x, self.weights)

    def spread(self, x: Sequence[Column]) -> Column:
        """Standard error of a single new value at ``x``."""
        terms = [x[i] * x[j] * F.lit(float(self.inverse[i, j] * (1 if i == j else 2))) for i, j in _square(len(x))]
        return F.lit(self.deviation) * F.sqrt(F.lit(1.0) + reduce(lambda a, b: a + b, terms))


def least_squares(df: DataFrame, x: Sequence[Column], y: Column) -> Line:
    """Ordinary least squares of ``y`` on ``x`` (name the constant yourself). Needs more rows than features and
    features that do not depend on each other; else a ``ValueError`` says so."""
    k = len(x)
    sums = [F.sum(x[i] * x[j]) for i, j in _square(k)] + [F.sum(c * y) for c in x] + [F.sum(y * y), F.count(y)]
    row = df.agg(*sums).first()
    n = int(row[-1])
    if n <= k:
        raise ValueError(f"{n} rows cannot determine {k} weights and their error")
    a, b, yy = _symmetric(k, row[:k * (k + 1) // 2]), np.array(row[k * (k + 1) // 2:-2], float), float(row[-2])
    if np.linalg.matrix_rank(a, hermitian=True) < k:
        raise ValueError("features depend on each other")
    weights = np.linalg.solve(a, b)
    left = max(0.0, yy - 2 * float(weights @ b) + float(weights @ a @ weights))
    return Line(weights, np.linalg.inv(a), float(np.sqrt(left / (n - k))), n)


# ---------------------------------------------------------------- logistic regression

def logistic(df: DataFrame, x: Sequence[Column], y: Column, penalty: float = 1.0, rounds: int = 25,
             tolerance: float = 1e-10) -> np.ndarray:
    """Weights of a logistic regression of the 0/1 column ``y`` on ``x``, by iteratively reweighted least squares:
    Newton steps from weighted cross products. The squares of all weights but the first (the constant's) are
    penalised, so that separable data have an answer too."""
    k = len(x)
    weights, ridge = np.zeros(k), np.diag([0.0] + [penalty] * (k - 1))
    for _ in range(rounds):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-linear(x, weights)))
        rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], dbl(y).alias("y"), p.alias("p"))
        w = F.col("p") * (F.lit(1.0) - F.col("p"))
        sums = [F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in _square(k)]
        row = rows.agg(*sums, *[F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")) for i in range(k)], F.count("y")).first()
        if not row[-1]:
            raise ValueError("no rows to fit")
        a, g = _symmetric(k, row[:k * (k + 1) // 2]), np.array(row[k * (k + 1) // 2:-1], float)
        step = np.linalg.solve(a + ridge + 1e-12 * np.eye(k), g - ridge @ weights)
        weights = weights + step
        if np.abs(step).max() <= tolerance:
            break
    return weights


# ---------------------------------------------------------------- k-means

GRID = 1_000_000  # standard scores are held in millionths, so that sums are exact and no partitioning changes them


def _far(x: Sequence[str], centre: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [(dbl(c) - F.lit(float(v))) * (dbl(c) - F.lit(float(v))) for c, v in zip(x, centre)])


def nearest_centre(x: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """Number (from 0) and squared distance of the nearest centre, of equally near ones the first: struct d, i."""
    options = [F.struct(_far(x, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    return options[0] if len(options) == 1 else F.least(*options)


def k_means(points: DataFrame, key: str, x: Sequence[str], k: int, rounds: int = 15) -> list[tuple[float, ...]]:
    """Centres by Lloyd's rounds over whole-number columns ``x``.

    Seeds need no chance: the point with the greatest first column, then again and again the point furthest from all
    seeds so far (ties: smallest key). Each round sums the points of each centre map-side; a centre without points
    stays where it is. Ends when no centre moves. Fewer different points than ``k`` give fewer centres.
    """
    x = list(x)
    first = points.agg(F.min(F.struct((-F.col(x[0])).alias("_order"), F.col(key).alias("_key"), *x)).alias("s")).first()["s"]
    if first is None:
        return []
    centres = [tuple(float(first[c]) for c in x)]
    while len(centres) < k:
        far = nearest_centre(x, centres)["d"]
        best = points.agg(F.min(F.struct((-far).alias("_order"), F.col(key).alias("_key"), *x)).alias("s")).first()["s"]
        if best["_order"] == 0:
            break
        centres.append(tuple(float(best[c]) for c in x))
    for _ in range(rounds):
        sums = points.groupBy(nearest_centre(x, centres)["i"].alias("_i")).agg(
            F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in x]).collect()
        moved = list(centres)
        for row in sums:
            moved[row["_i"]] = tuple(float(row[c]) / row["_n"] for c in x)
        if moved == centres:
            break
        centres = moved
    return centres
