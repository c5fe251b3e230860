"""Approximate nearest neighbours by balanced posting lists (after Chen et al., "SPANN").

Centroids come from a bounded sample, split in halves of equal size until a list's share is reached, so lists
are balanced. A navigable graph in memory searches the centroids, which are bounded in number and travel with
the tasks. Every vector is in the list of its nearest centroid and, near a border, in those of others about
as near. A query reads all lists whose centroid is within a ratio of its nearest centroid's distance. The
ratio is learned: a bounded set of queries is answered exactly against all rows, and the ratio is the one at
which their true neighbours' lists are read. Queries that find fewer answers than wanted go to more lists, in
the end to all.

Equal vectors are one entry that carries its smallest ids, as many as an answer can hold. Lists are cut into
pieces of bounded size, which are dealt out to tasks; a query goes once to every task that holds a piece of its lists.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from stallkeeper.llm.common import stored
from stallkeeper.llm.hnsw import Graph
from stallkeeper.llm.vectors import matrix, usable

K = 10
LIST = 128           # distinct vectors of a list, about
LISTS = 4096         # centroids at most
PER_LIST = 16        # sampled vectors per centroid: the sample holds LISTS * PER_LIST vectors at most
BORDER = 1.05        # a vector is also in lists up to this ratio of its nearest centroid's distance
AUDIT = 64           # queries answered exactly to learn the ratio
RECALL = 0.97        # share of the audited neighbours whose lists are read
WIDER = (2, 8)       # factors of the ratio for queries short of answers, before they go to all lists
PIECE = 4096         # entries compared at a time
DEALT = 16_384       # entries of a list that stay together in one task, about
GROUP = 60_000       # entries of a task, about
SENT = 20_000        # rows of an Arrow batch that a task gives back, at most


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` parts of nearly equal size: each part is halved across the line between two far
    centres, found by a few rounds of two-means."""
    rng = np.random.RandomState(1)
    parts, done = [(np.arange(len(sample)), lists)], []
    while parts:
        own, count = parts.pop()
        if count <= 1 or len(own) < 2:
            done.append(sample[own].mean(0))
            continue
        x = sample[own]
        a, b = x[rng.randint(len(x))], x[rng.randint(len(x))]
        for _ in range(5):
            side = ((x - a) ** 2).sum(1) < ((x - b) ** 2).sum(1)
            if side.all() or not side.any():
                break
            a, b = x[side].mean(0), x[~side].mean(0)
        order = np.argsort(x @ (a - b), kind="stable")
        left = count // 2
        cut = len(own) * left // count
        parts += [(own[order[:cut]], left), (own[order[cut:]], count - left)]
    return np.array(done)


def distances(graph: Graph, q: np.ndarray, closeness: np.ndarray) -> np.ndarray:
    """Euclidean distances from the closeness the graph ranks by."""
    return np.sqrt(np.maximum((q.astype(np.float32) ** 2).sum(1) - 2 * closeness, 0))


def lists_within(graph: Graph, q: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, ratio to the nearest) of all lists within ``ratio`` of each row's nearest centroid."""
    rows, lists, ratios = [], [], []
    for at in range(0, len(q), 512):
        x = np.ascontiguousarray(q[at:at + 512], np.float32)
        beam = graph.nearest(x, 32)
        first, best = (part[:, 0] for part in beam)
        near = distances(graph, x, best)
        far = near * ratio + 1e-6
        row, node, close = graph.within(x, ((x ** 2).sum(1) - far ** 2) / 2, 32, beam)
        lost = np.setdiff1d(np.arange(len(x)), row)  # by rounding: to the nearest list all the same
        row, node = np.concatenate([row, lost]), np.concatenate([node, first[lost]])
        d = distances(graph, x[row], np.concatenate([close, best[lost]]))
        rows.append(row + at)
        lists.append(node)
        ratios.append(d / np.maximum(near[row], 1e-9))
    if not rows:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return np.concatenate(rows), np.concatenate(lists), np.concatenate(ratios)


def _post(shared, ratio: float):
    """Entries with their lists, those within the ratio."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for batch in batches:
            row, node, _ = lists_within(graph, matrix(batch.column("v")), ratio)
            order = np.lexsort((node, row))
            ends = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(node[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "lists"])
    return run


def task_of(lists: np.ndarray, piece: np.ndarray, groups: int) -> np.ndarray:
    return (lists * 2_147_483_647 + piece * 1_000_003) % groups  # primes: all tasks get their share


def _dealt(batch: pa.RecordBatch, row: np.ndarray, node: np.ndarray, piece: np.ndarray, plan,
           names: list[str]) -> Iterator[pa.RecordBatch]:
    """The named columns of the rows, once per task that has one of their pieces, with their lists there."""
    pieces, groups = plan
    # Several pieces of a list in one task count as one.
    pair, node = np.divmod(np.unique((row * groups + task_of(node, piece, groups)) * len(pieces) + node), len(pieces))
    first = np.unique(pair, return_index=True)[1]
    ends = np.r_[first[1:], len(pair)]
    for at in range(0, len(first), SENT):
        a, b = first[at:at + SENT], ends[at:at + SENT][-1]
        own, task = np.divmod(pair[a], groups)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[a, b] - a[0], pa.int32()), pa.array(node[a[0]:b], pa.int32()))
        kept = batch.select(names).take(pa.array(own))
        yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), lists, *kept.columns], ["task", "lists", *names])


def _deal(plan):
    """Entries for every task that has a piece of theirs; which piece of a list that is depends on the vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("lists")
            node = lists.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            yield from _dealt(batch, row, node, batch.column("h").to_numpy()[row] % plan.value[0][node], plan.value, ["ids", "v"])
    return run


def _ask(shared, plan, ratio: float | None):
    """Queries for every task that has a piece of a list within the ratio (None: of any list)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, pieces = shared.value, plan.value[0]
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                if ratio is None:
                    row, node = (x.ravel() for x in np.indices((batch.num_rows, len(pieces))))
                else:
                    row, node, _ = lists_within(graph, matrix(batch.column("v")), ratio)
                count = pieces[node]
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield from _dealt(batch, np.repeat(row, count), np.repeat(node, count), piece, plan.value, ["query_id", "v"])
    return run


def exact_nearest(q: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``x`` and Euclidean distances of the nearest ``most`` of each query, ties included."""
    take = min(most, len(x))
    rough = (x * x).sum(1)[None, :] - 2 * q @ x.T
    margin = 1e-9 * ((q * q).sum(1)[:, None] + (x * x).sum(1).max())
    edge = np.partition(rough, take - 1, axis=1)[:, take - 1:take] + margin
    row, col = np.nonzero(rough <= edge)
    d = q[row] - x[col]
    return row, col, np.sqrt((d * d).sum(1))


def _audit(shared, most: int):
    """Nearest entries of every audited query within a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        row, score, near = np.empty(0, int), np.empty(0), np.empty((0, q.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                x = matrix(batch.column("v").slice(at, PIECE))
                new, col, d = exact_nearest(q, x, most)
                other = d > 0  # the query's own vector is found at any ratio
                row, score = np.r_[row, new[other]], np.r_[score, d[other]]
                near = np.concatenate([near, x[col[other]]])
                order = np.lexsort((score, row))
                place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                kept = order[place < most]
                row, score, near = row[kept], score[kept], near[kept]
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * q.shape[1], pa.int32()), pa.array(near.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(score), vectors], ["q", "score", "v"])
    return run


def hash_sample(entries: DataFrame, n: int, most: int) -> np.ndarray:
    """The vectors of the ``most`` smallest hashes among ``n`` entries, by hash. Each task gives back only rows under a
    bound that lets a few more than ``most`` through in all, so that what is brought together does not grow with the
    number of tasks."""
    most = min(n, most)
    through = most + 8 * most ** 0.5 + 8
    h = F.xxhash64(F.col("v").cast("array<double>"))
    while True:
        bound = int(2 ** 64 * through / n) - 2 ** 63
        low = entries.select("v") if through >= n else entries.select("v").where(h < F.lit(bound))
        sample = low.orderBy(h).limit(most).toArrow()
        if sample.num_rows == most or through >= n:
            return matrix(sample.column("v"))
        through *= 2


def learned_ratio(spark, entries: DataFrame, queries: DataFrame, graph: Graph, shared, k: int, recall: float) -> float:
    """The distance ratio that reads a list of the wanted share of the audited queries' true neighbours."""
    sample = queries.orderBy(F.xxhash64("query_id", F.lit(5)), "query_id").limit(AUDIT).select("v").collect()  # bounded
    if not sample:
        return 1.0
    q = np.array([r["v"] for r in sample])
    found = entries.select("v").mapInArrow(_audit(spark.sparkContext.broadcast(q), k + 1), "q int, score double, v array<double>")
    rank = F.row_number().over(W.partitionBy("q").orderBy("score"))
    truth = found.withColumn("_r", rank).where(F.col("_r") <= k).select("q", "v").collect()  # AUDIT * k rows
    if not truth:
        return 1.0
    of = np.array([r["q"] for r in truth])
    v = np.array([r["v"] for r in truth])
    row, node, _ = lists_within(graph, v, BORDER)
    centre = graph.vectors.astype(np.float64)
    near = np.sqrt(((q[:, None, :] - centre[None, :, :]) ** 2).sum(2))
    need = np.full(len(v), np.inf)
    np.minimum.at(need, row, near[of[row], node] / np.maximum(near[of[row]].min(1), 1e-9))
    return float(np.quantile(need, recall) * 1.002)


def by_list(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The lists of a task's rows in order, and the row of each."""
    lists = rows.column("lists").combine_chunks()
    node, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    order = np.argsort(node, kind="stable")
    return node[order], row[order]


def _scan(k: int):
    """A task's entries and queries: per query the nearest k + 1 entries of its lists, as far as they are in the task."""
    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())),
                          "score": pa.array([], pa.float64())})
        if not entries.num_rows or not queries.num_rows:
            return empty
        x, q = matrix(entries.column("v")), matrix(queries.column("v"))
        qid = queries.column("query_id").to_numpy()
        (list_x, row_x), (list_q, row_q) = by_list(entries), by_list(queries)
        at_q, at_x, scores = [], [], []
        for key in np.intersect1d(list_x, list_q):
            own_x = row_x[np.searchsorted(list_x, key):np.searchsorted(list_x, key, "right")]
            own_q = row_q[np.searchsorted(list_q, key):np.searchsorted(list_q, key, "right")]
            for b in range(0, len(own_x), PIECE):
                block = own_x[b:b + PIECE]
                near = x[block]
                for a in range(0, len(own_q), 512):
                    part = own_q[a:a + 512]
                    row, col, score = exact_nearest(q[part], near, k + 1)
                    at_q.append(part[row])
                    at_x.append(block[col])
                    scores.append(score)
        if not at_q:
            return empty
        at_q, at_x, score = np.concatenate(at_q), np.concatenate(at_x), np.concatenate(scores)
        first_id = pc.list_element(entries.column("ids"), 0).to_numpy()
        order = np.lexsort((at_x, first_id[at_x], score, qid[at_q]))
        at_q, at_x, score = at_q[order], at_x[order], score[order]
        same = (qid[at_q][1:] == qid[at_q][:-1]) & (at_x[1:] == at_x[:-1])  # found in several lists
        keep = np.r_[True, ~same]
        at_q, at_x, score = at_q[keep], at_x[keep], score[keep]
        begins = np.flatnonzero(np.r_[True, qid[at_q][1:] != qid[at_q][:-1]])
        place = np.arange(len(at_q)) - np.repeat(begins, np.diff(np.r_[begins, len(at_q)]))
        keep = place <= k
        return pa.table({"query_id": pa.array(qid[at_q[keep]], pa.int64()),
                         "ids": entries.column("ids").take(pa.array(at_x[keep])), "score": pa.array(score[keep])})
    return run


def nearest(df: DataFrame, is_query, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding",
            per_list: int = LIST, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest rows found for every row that ``is_query``.

    Distances are exact, in double precision on the original vectors. Ties go to the smaller id. A row is no
    answer to a query of its own id. Vectors that are null, empty, zero or hold null or non-finite parts, rows
    without an id, and vectors of another length than most take no part. Repeated ids are entries of their
    own; a query id answers for its first vector. Fewer rows than k give all of them, an empty table none.
    """
    spark = df.sparkSession
    kind = "float" if df.schema[vector_column].dataType.elementType.simpleString() == "float" else "double"
    vec_id, v = F.col(id_column).cast("bigint"), F.col(vector_column)
    rows = df.where(vec_id.isNotNull() & usable(v.cast("array<double>"))).select(
        vec_id.alias("vec_id"), v.cast(f"array<{kind}>").alias("v")).withColumn("dim", F.size("v"))
    size = F.transform("v", lambda x: F.abs(x).cast("double"))
    common = rows.groupBy("dim").agg(
        F.count("*").alias("n"), F.max(F.array_max(size)).alias("top"),
        F.min(F.array_min(F.filter(size, lambda x: x > 0))).alias("least")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.col("dim") == common["dim"]).select("vec_id", "v")
    # All vectors shrink by one power of two, so that no square overflows; that changes no digit, and distances grow back.
    scale = 2.0 ** max(-1000, min(1000, int(np.frexp(common["top"])[1])))
    unit_ = F.lit(scale)
    # Single precision stays so unless small parts would lose digits by shrinking.
    kind = "float" if kind == "float" and common["least"] / scale >= 2.0 ** -126 else "double"
    vector = f"v array<{kind}>"
    rows = rows.withColumn("v", F.transform("v", lambda x: (x / unit_).cast(kind)))
    queries = stored(rows.where(is_query(F.col("vec_id"))).groupBy(F.col("vec_id").alias("query_id")).agg(
        F.min("v").alias("v")))
    order = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    entries = stored(rows.withColumn("_r", order).where(F.col("_r") <= k + 1).groupBy("v").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids")))  # k + 1 ids at most
    n = entries.count()
    lists = int(min(LISTS, max(1, -(-n // per_list))))
    graph = Graph(balanced_centroids(hash_sample(entries, n, lists * PER_LIST), lists), euclidean=True)  # bounded
    shared = spark.sparkContext.broadcast(graph)  # LISTS centroids at most
    ratio = learned_ratio(spark, entries, queries, graph, shared, k, recall)
    posted = stored(entries.withColumn("h", F.xxhash64("v")).mapInArrow(
        _post(shared, BORDER), f"{vector}, ids array<bigint>, h bigint, lists array<int>"))
    sizes = posted.select(F.explode("lists").alias("list")).groupBy("list").count().collect()  # LISTS rows
    pieces = np.zeros(lists, np.int64)
    pieces[[r["list"] for r in sizes]] = [-(-r["count"] // DEALT) for r in sizes]
    groups = max(6, -(-sum(r["count"] for r in sizes) // GROUP))
    plan = spark.sparkContext.broadcast((pieces, groups))
    left = posted.mapInArrow(_deal(plan), f"task int, lists array<int>, ids array<bigint>, {vector}")

    def answered(asked: DataFrame, reach: float | None) -> DataFrame:
        right = asked.mapInArrow(_ask(shared, plan, reach), f"task int, lists array<int>, query_id bigint, {vector}")
        hits = left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(
            _scan(k), "query_id bigint, ids array<bigint>, score double")
        return hits.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id").distinct()

    answers = stored(answered(queries, ratio))
    for wider in (*WIDER, None):
        full = answers.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
        short = stored(queries.join(full, "query_id", "left_anti"))
        if short.isEmpty():
            break
        more = answered(short, wider and ratio * wider)
        answers = stored(answers.unionAll(more).distinct())
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", (F.col("score") * unit_).alias("score"))
