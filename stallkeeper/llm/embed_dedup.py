"""Embedding near-duplicates: a small-world graph per shard, every shard queried, beams widened until recall
audits pass, cosines verified in double precision, components united.

Equal vectors are one node. Nodes are dealt by hash to shards of bounded size; a shard is built once and
stored. Each pair of shards meets in one task: the vectors of the one walk the graph of the other, so every
vector is held against every shard and a link is found once for both ends. A task counts links per node and
reports only those links that join nodes not joined yet in its pair of shards.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stallkeeper.llm.common import stored
from stallkeeper.llm.components import connected
from stallkeeper.llm.hnsw import M, Graph
from stallkeeper.llm.vectors import matrix, rows_of, unit

COSINE = 0.95
SHARD = 8192     # distinct vectors of a shard, about
BEAM = 24
TRUE_LINKS = 400  # links to others that a task's audit tests, or all there are
RECALL = 0.98
BLOCK = 512      # queries that walk together


def _build(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    exact = unit(matrix(table.column("v")))
    return pa.table({"shard": table.column("shard").slice(0, 1), "dim": table.column("dim").slice(0, 1),
                     "ids": pa.array([table.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                     "copies": pa.array([table.column("copies").to_numpy().astype("<i8").tobytes()], pa.binary()),
                     "exact": pa.array([exact.astype("<f8").tobytes()], pa.binary()),
                     "graph": pa.array([Graph(exact).dump()], pa.binary())})


def exact_links(queries: np.ndarray, at: np.ndarray, exact: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (query row, node) of the queries at the given rows, against every node."""
    rough, node = np.nonzero(queries[at] @ exact.T >= cosine - 1e-9)
    row = at[rough]
    good = np.empty(len(row), bool)
    for a in range(0, len(row), 1 << 17):
        part = slice(a, a + (1 << 17))
        good[part] = np.einsum("ij,ij->i", queries[row[part]], exact[node[part]]) >= cosine
    return row[good], node[good]


def audited(queries: np.ndarray, exact: np.ndarray, cosine: float, same: bool,
            links: int = TRUE_LINKS) -> tuple[np.ndarray, np.ndarray, bool]:
    """Exact pairs of spread queries, block by block until ``links`` of them join two different vectors or all
    queries are answered, and whether all were. ``same``: a query's own node is the one of its row."""
    order = np.random.RandomState(7).permutation(len(queries))
    rows, nodes, true, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, 0
    while at < len(order) and true < links:
        row, node = exact_links(queries, order[at:at + BLOCK], exact, cosine)
        true += int((row != node).sum()) if same else len(row)
        rows.append(row)
        nodes.append(node)
        at += BLOCK
    return np.concatenate(rows), np.concatenate(nodes), at >= len(order)


def found_links(queries: np.ndarray, graph: Graph, exact: np.ndarray, cosine: float, beam: int = BEAM,
                recall: float = RECALL, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, node) with cosine >= ``cosine``, by walks of the graph.

    The walk uses single precision and a margin; cosines are then taken in double precision. Spread queries
    are also answered exactly until enough true links are tested, a query's own node left out; while the walk
    finds less than ``recall`` of them, the beam and the margin are widened and the queries walk again. Where
    links are so few that all queries had to be answered exactly, or where no beam cheaper than that gets there
    (a graph in parts), the exact answers are the result.
    """
    true_row, true_node, whole = audited(queries, exact, cosine, same)
    if whole:
        return true_row, true_node
    tested = true_row != true_node if same else np.ones(len(true_row), bool)
    truth = true_row[tested] * len(exact) + true_node[tested]
    margin = 0.01
    while True:
        rows, nodes = [true_row], [true_node]
        for at in range(0, len(queries), BLOCK):
            q = queries[at:at + BLOCK]
            r, x, _ = graph.within(q, np.full(len(q), cosine - margin, np.float32), beam)
            for a in range(0, len(r), 1 << 17):
                part = slice(a, a + (1 << 17))
                good = np.einsum("ij,ij->i", q[r[part]], exact[x[part]]) >= cosine
                rows.append(r[part][good] + at)
                nodes.append(x[part][good])
        walked = np.concatenate(rows[1:]) * len(exact) + np.concatenate(nodes[1:])
        if np.isin(truth, walked).sum() >= recall * len(truth):
            return np.divmod(np.unique(np.concatenate([walked, true_row * len(exact) + true_node])), len(exact))
        if beam * 2 * M >= len(exact):  # such a walk meets about every node
            break
        beam, margin = beam * 2, margin * 2
    parts = [exact_links(queries, np.arange(at, min(at + BLOCK, len(queries))), exact, cosine)
             for at in range(0, len(queries), BLOCK)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def joining(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the ends of the given links into their components."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        shards = sorted(table.to_pylist(), key=lambda r: r["shard"])
        one, two = shards[0], shards[-1]
        dim = one["dim"]
        ids = [np.frombuffer(s["ids"], "<i8") for s in (one, two)]
        copies = [np.frombuffer(s["copies"], "<i8") for s in (one, two)]
        exact = [np.frombuffer(s["exact"], "<f8").reshape(-1, dim) for s in (one, two)]
        row, node = found_links(exact[0], Graph.load(two["graph"]), exact[1], cosine, same=len(shards) == 1)
        if len(shards) == 1:  # a shard with itself: a link may be found from either end
            pairs = np.unique(np.stack([np.minimum(row, node), np.maximum(row, node)], 1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            row, node = pairs[:, 0], pairs[:, 1]
        left, right = ids[0][row], ids[1][node]
        count = [np.bincount(row, copies[1][node], len(ids[0])), np.bincount(node, copies[0][row], len(ids[1]))]
        a, b = joining(left, right)
        out_id = np.concatenate([ids[0][count[0] > 0], ids[1][count[1] > 0], a])
        out_n = np.concatenate([count[0][count[0] > 0], count[1][count[1] > 0], np.zeros(len(a))]).astype(np.int64)
        other = np.concatenate([np.full(len(out_id) - len(a), -1), b])
        return pa.table({"id": pa.array(out_id, pa.int64()), "n": pa.array(out_n, pa.int64()),
                         "other": pa.array(other, pa.int64(), mask=np.arange(len(out_id)) < len(out_id) - len(a))})
    return run


def near_duplicates(df: DataFrame, cosine: float = COSINE, shard: int = SHARD, id_column: str = "vec_id",
                    vector_column: str = "embedding") -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite parts link with nothing and stand alone.
    Vectors of different lengths do not link. Equal vectors link with each other and share all links. Rows
    that repeat an id are vectors of their own. Rows without an id have the component of equal vectors that
    have one, else null, and are not kept. An empty table gives no rows.
    """
    rows = stored(rows_of(df, id_column, vector_column))
    nodes = stored(rows.where("v is not null").groupBy("v").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v"))
        .withColumn("id", F.monotonically_increasing_id()))  # a number of the node, fixed by the store
    known = nodes.where("vec_id is not null")
    shards = max(1, -(-known.count() // shard))
    built = stored(known.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
                   .groupBy("dim", "shard").applyInArrow(
                       _build, "shard int, dim int, ids binary, copies binary, exact binary, graph binary"))
    partner = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    met = (built.withColumn("_p", partner).withColumn("low", F.least("shard", "_p"))
           .withColumn("high", F.greatest("shard", "_p")).drop("_p"))
    found = stored(met.groupBy("dim", "low", "high").applyInArrow(_both(_compare(cosine)),
                                                                  "id bigint, n bigint, other bigint"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    component = connected(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    labelled = nodes.join(component, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("component", "id"))
    smallest = labelled.groupBy("root").agg(F.min("vec_id").alias("_component"))
    classes = (labelled.join(smallest, "root").join(counts, "id", "left")
               .select(F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       "_component"))
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                           F.col("vec_id").alias("component_id"))
    linked = rows.where("v is not null").join(classes, F.col("v") == F.col("_v")).select(
        "vec_id", F.col("n_links").cast("bigint").alias("n_links"), F.col("_component").alias("component_id"))
    return linked.unionAll(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _both(compare):
    """``compare``, but for pairs of shards of which only one has vectors of this length."""
    def run(key, table):
        low, high = key[1].as_py(), key[2].as_py()
        if low != high and table.num_rows < 2:
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()),
                             "other": pa.array([], pa.int64())})
        return compare(table)
    return run
