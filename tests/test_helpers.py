"""The distributed helpers against brute force, with hot values and hot groups."""
from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from stallkeeper.functions import (half_up, global_rank, micros_between, nearest_rank, nth_row_per_key, tile,
                                   top_row_per_key)
from stallkeeper.operators.association import pair_counts


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 101])
def test_nearest_rank_positions(spark, n):
    rows = [(float(i * i - 7),) for i in range(1, n + 1)]
    got = nearest_rank(spark.createDataFrame(rows, "v double").repartition(3), "v",
                       {"q1": "0.25", "median": "0.5", "q3": "0.75"}).head()
    want = sorted(v for v, in rows)
    assert got["value_count"] == n
    assert got["q1"] == want[(n + 3) // 4 - 1]
    assert got["median"] == want[(n + 1) // 2 - 1]
    assert got["q3"] == want[(3 * n + 3) // 4 - 1]


def test_nearest_rank_hot_value_signs_and_groups(spark):
    rnd = random.Random(3)
    data = {g: [rnd.choice([-1.5, 0.0, 12.25]) if rnd.random() < 0.5 else round(rnd.lognormvariate(4, 3), 2) * rnd.choice([-1, 1])
                for _ in range(700)] for g in ("a", "b")}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("a", None)]
    got = nearest_rank(spark.createDataFrame(rows, "g string, v double").repartition(5), "v",
                       {"p20": "0.2", "p60": "0.6", "p99": "0.99"}, ["g"]).collect()
    assert len(got) == 2
    for r in got:
        want = sorted(data[r["g"]])
        for name, num in (("p20", 20), ("p60", 60), ("p99", 99)):
            assert r[name] == want[-(-num * len(want) // 100) - 1]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_global_rank_and_tiles(spark, kind):
    rnd = random.Random(5)
    rows = []
    for i in range(1203):
        tie = i if kind == "bigint" else f"{rnd.randrange(16 ** 6):06x}-{i}"
        rows.append(("hot" if i % 3 else "cold", 500 if rnd.random() < 0.4 else rnd.randrange(1, 90_000), tie))
    df = spark.createDataFrame(rows, f"g string, v bigint, id {kind}").repartition(7)
    got = global_rank(df, ["g"], "v", "id").withColumn("t", tile(F.col("rank"), F.col("n"), 4)).collect()
    assert len(got) == len(rows)
    for g in ("hot", "cold"):
        want = sorted((v, t) for gg, v, t in rows if gg == g)
        mine = sorted((r["rank"], r["v"], r["id"], r["t"], r["n"]) for r in got if r["g"] == g)
        assert [(v, t) for _, v, t, _, _ in mine] == want
        assert [r for r, *_ in mine] == list(range(1, len(want) + 1))
        q, rest = divmod(len(want), 4)
        tiles = [k + 1 for k in range(4) for _ in range(q + (k < rest))]
        assert [t for *_, t, _ in mine] == tiles


@pytest.mark.parametrize("block", [1, 3, 256])
def test_pair_counts_equal_brute_force_at_any_block_size(spark, block):
    rnd = random.Random(11)
    baskets = {o: set(rnd.choices(range(25), k=rnd.choice([1, 2, 3, 6, 9]))) for o in range(120)}
    for giant in (997, 998, 999):  # giant orders that share items
        baskets[giant] = set(range(25)) | set(range(1000, 1060))
    want = Counter()
    for items in baskets.values():
        want.update(combinations(sorted(items), 2))
    rows = [(o, i) for o, items in baskets.items() for i in items]
    df = spark.createDataFrame(rows, "order_id int, item int")
    got = {(r["a"], r["b"]): r["n"] for r in pair_counts(df, 3, block).collect()}
    assert got == {p: n for p, n in want.items() if n >= 3}


def test_row_per_key_survives_repartitioning(spark):
    rows = [("hot", i % 50, i) for i in range(3000)] + [("cold", 1, 1), ("cold", 2, 0)]
    results = set()
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "k string, a int, b int").repartition(parts)
        first = top_row_per_key(df, ["k"], [F.desc("a"), F.desc("b")]).collect()
        second = nth_row_per_key(df, ["k"], [F.asc("a"), F.asc("b")], 2).collect()
        results.add((tuple(sorted(map(tuple, first))), tuple(sorted(map(tuple, second)))))
    assert results == {((("cold", 2, 0), ("hot", 49, 2999)), (("cold", 2, 0), ("hot", 0, 50)))}


def test_half_up_and_micros(spark):
    r = spark.range(1).select(
        half_up(F.lit(0.675), 2).alias("a"), half_up(F.lit(-1.005), 2).alias("b"),
        micros_between(F.expr("timestamp_ntz'2018-03-11 03:00:00.25'"), F.expr("timestamp_ntz'2018-03-10 03:00:00'")).alias("m")).head()
    assert (r["a"], r["b"], r["m"]) == (0.68, -1.01, 86_400_250_000)
    assert math.isclose(r["a"], 0.68)
