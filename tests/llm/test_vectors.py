"""Search and near-duplicates of embeddings against all pairs."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallkeeper.llm import ann, embed_dedup
from stallkeeper.llm.hnsw import Graph
from stallkeeper.llm.vectors import unit


@pytest.fixture(scope="module")
def cloud():
    """Vectors with tight groups, copies and scaled copies."""
    rng = np.random.RandomState(0)
    base = rng.randn(900, 16)
    tight = base[:6].repeat(60, 0) + 0.05 * rng.randn(360, 16)
    return np.concatenate([base, tight, base[:40], 3 * base[:20]]).astype(np.float32)


def frame(spark, vectors, ids=None):
    rows = [(int(i), [float(x) for x in v], "x", "y") for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string, v string")


ODD = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
       (7, [1.0, 2.0]), (8, [1.0, 2.0]), (7, [2.0, 4.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (10, [-1.0, 0.5]), (None, None)]


def odd(spark):
    return spark.createDataFrame(ODD, "vec_id bigint, embedding array<float>")


def test_graph_finds_neighbours(cloud):
    x = unit(cloud[:900].astype(np.float64)).astype(np.float32)
    graph = Graph.load(Graph(x).dump())
    ids, _ = graph.nearest(x[:200], 64)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(ids.tolist(), true.tolist())]) > 9.5


@pytest.mark.parametrize("shard", [200, 8192])
def test_near_duplicates_against_all_pairs(spark, cloud, shard):
    u = unit(cloud.astype(np.float64))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(u))
    while True:
        low = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(u))])
        if (low == label).all():
            break
        label = low
    rows = {r["vec_id"]: r for r in embed_dedup.near_duplicates(frame(spark, cloud), shard=shard).collect()}
    got, want = (np.array([rows[i]["n_links"] for i in range(len(u))]), near.sum(1))
    assert (got <= want).all() and got.sum() >= 0.98 * want.sum()
    assert np.mean([rows[i]["component_id"] == label[i] for i in range(len(u))]) > 0.98
    assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items())


@pytest.mark.parametrize("same", [True, False])
def test_links_that_walks_miss_are_noticed(same):
    """A graph of two parts that do not reach each other, and few links among many vectors."""
    rng = np.random.RandomState(5)
    base = unit(rng.randn(700, 24))
    for few in (True, False):
        near = np.arange(0, 700, 30 if few else 1)
        other = unit(rng.randn(700, 24)) if few else base.copy()
        other[near] = unit(base[near] + 0.02 * rng.randn(len(near), 24))
        nodes = np.concatenate([other, base]) if same else other
        queries = nodes if same else base
        graph = Graph(nodes)
        for links in graph.layers:  # only the first nodes can be reached
            links[links >= 300] = -1
        row, node = embed_dedup.found_links(queries, graph, nodes, 0.95, same=same)
        want = np.argwhere(queries @ nodes.T >= 0.95)
        assert len(set(zip(row.tolist(), node.tolist()))) == len(row)
        assert len(set(zip(row.tolist(), node.tolist())) & set(map(tuple, want.tolist()))) >= 0.98 * len(want)


def test_near_duplicates_odd_rows(spark):
    rows = embed_dedup.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], []).append(r)
    assert all(by[i][0]["n_links"] == 0 and by[i][0]["component_id"] == i and by[i][0]["kept"] for i in (1, 2, 3, 4, 5, 6, 9))
    assert by[8][0]["component_id"] == 7 and by[8][0]["n_links"] == 3 and not by[8][0]["kept"]
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embed_dedup.near_duplicates(empty).count() == 0


def test_search_against_all_rows(spark, cloud):
    x = cloud.astype(np.float64)
    rows = ann.nearest(frame(spark, cloud), lambda i: i % 10 == 0, per_list=32).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, len(x), 10))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        true = sorted(zip(d, range(len(x))))[:10]
        assert len(found) == 10 and all(abs(d[i] - s) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda f: (f[1], f[0]))
        hits += len({i for i, _ in found} & {i for _, i in true})
    assert hits >= 0.9 * 10 * len(got)


def test_search_odd_rows(spark):
    rows = ann.nearest(odd(spark), lambda i: i % 1 == 0).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {7, 8, 10}
    assert [v for v, _ in got[8]] == [7, 7, 10] and got[8][0][1] == 0
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert ann.nearest(empty, lambda i: i % 1 == 0).count() == 0
    one = spark.createDataFrame([(100, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert ann.nearest(one, lambda i: i % 100 == 0).count() == 0


def test_every_query_is_answered_in_full(spark):
    """A far cluster that fills a list of its own with fewer vectors than answers, and an outlier."""
    rng = np.random.RandomState(8)
    x = np.concatenate([rng.randn(791, 8), 500 + 0.1 * rng.randn(8, 8), np.full((1, 8), -4000.0)])
    rows = ann.nearest(frame(spark, x), lambda i: i >= 780, per_list=8).collect()
    count = {i: sorted(r["rank"] for r in rows if r["query_id"] == i) for i in range(780, 800)}
    assert all(c == list(range(1, 11)) for c in count.values())
    for q in range(791, 799):  # the others of the cluster come first
        assert {r["vec_id"] for r in rows if r["query_id"] == q and r["rank"] <= 7} == set(range(791, 799)) - {q}
    few = ann.nearest(frame(spark, x[:4]), lambda i: i >= 0).collect()
    assert sorted(r["rank"] for r in few) == sorted([1, 2, 3] * 4)


@pytest.mark.parametrize("size", [1e20, 1e-25, 1.0])
def test_search_whatever_the_magnitude(spark, size):
    """Squares of large vectors overflow single precision, those of small ones vanish in it."""
    x = np.random.RandomState(4).randn(300, 8) * size
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, lambda v: v % 100 == 0).collect()
    for q in (0, 100, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        rows = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in rows] == list(range(1, 11))
        assert len(set(np.argsort(d)[:10].tolist()) & {r[1] for r in rows}) >= 9
        assert all(s == pytest.approx(d[v], rel=1e-12) for _, v, s in rows)


def test_sample_does_not_grow_with_the_tasks(spark):
    """The sample for the centroids fits a limit that the rows of all tasks together pass."""
    x = np.random.RandomState(6).randn(24_000, 32)
    limit = spark.sparkContext._jsc.sc().conf()
    own = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in own}
    try:
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        limit.set("spark.driver.maxResultSize", "2m")
        for key, value in own.items():
            spark.conf.set(key, value)
        rows = ann.nearest(df, lambda i: i % 4000 == 0).collect()
        entries = df.select(df["embedding"].alias("v"))
        sample = ann.hash_sample(entries, len(x), 500)
    finally:
        limit.set("spark.driver.maxResultSize", "1g")
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted((r["query_id"], r["rank"]) for r in rows) == [(q, k) for q in range(0, 24_000, 4000) for k in range(1, 11)]
    by_hash = entries.orderBy(F.xxhash64("v")).limit(500).collect()
    assert sample.tolist() == [r["v"] for r in by_hash]


def test_pieces_of_large_lists(spark, monkeypatch):
    """Lists of several pieces, in as many tasks: every query meets all of them once."""
    monkeypatch.setattr(ann, "DEALT", 20)
    monkeypatch.setattr(ann, "GROUP", 100)
    monkeypatch.setattr(ann, "SENT", 7)
    x = np.random.RandomState(7).randn(600, 6)
    rows = ann.nearest(frame(spark, x), lambda i: i % 50 == 0, per_list=300, recall=1.0).collect()
    y = x.astype(np.float32).astype(np.float64)
    for q in range(0, 600, 50):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        got = [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert got == np.argsort(d, kind="stable")[:10].tolist()
