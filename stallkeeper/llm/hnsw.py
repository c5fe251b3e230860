"""A hierarchical navigable small-world graph (Malkov and Yashunin) over the vectors of one shard.

Closeness of a query q to a node x is q.x + bias[x]: bias 0 ranks unit vectors by cosine, bias -|x|^2/2 ranks
by Euclidean distance. Many queries walk the graph together, one array operation per step.
"""
from __future__ import annotations

import io

import numpy as np

M = 12            # links of a node in the upper layers, twice as many in the lowest
EF_BUILD = 32
BATCH = 512       # nodes inserted together: they also see each other


class Graph:
    """``layers``: from the lowest up, (nodes, links); a node's number is its row in ``vectors``."""

    def __init__(self, vectors: np.ndarray, euclidean: bool = False, layers: list | None = None):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.bias = (-(self.vectors ** 2).sum(1) / 2 if euclidean else np.zeros(len(vectors))).astype(np.float32)
        self.euclidean = euclidean
        self.layers = layers if layers is not None else self._build()

    # ------------------------------------------------------------ building

    def _build(self) -> list[np.ndarray]:
        n = len(self.vectors)
        draw = np.random.RandomState(3).random_sample(n)
        level = np.minimum(np.floor(-np.log(1 - draw) / np.log(M)), 6).astype(int)
        if n:
            level[0] = level.max()  # the first node is placed first everywhere: walks enter there
        top = int(level.max(initial=0))
        order = np.argsort(-level, kind="stable")
        layers: list[np.ndarray] = [np.full((n, 2 * M if k == 0 else M), -1, np.int32) for k in range(top + 1)]
        for k in range(top, -1, -1):
            nodes = order[:int((level >= k).sum())]
            for at in self._batches(len(nodes)):
                self._insert(layers, k, nodes[at], at.start)
        return layers

    @staticmethod
    def _batches(n: int):
        at = 0
        while at < n:
            step = min(BATCH, max(64, at // 2))
            yield slice(at, min(at + step, n))
            at += step

    def _insert(self, layers: list[np.ndarray], k: int, nodes: np.ndarray, placed: int) -> None:
        links, q = layers[k], self.vectors[nodes]
        own = q @ q.T + self.bias[nodes][None, :]
        np.fill_diagonal(own, -np.inf)
        width = min(16, len(nodes))
        near = np.argsort(-own, axis=1)[:, :width] if len(nodes) > 1 else np.empty((len(nodes), 0), int)
        ids, sims = nodes[near], np.take_along_axis(own, near, 1)
        if placed:
            found, close = self._walk(layers, k, q, min(EF_BUILD, placed))
            ids, sims = np.concatenate([found, ids], 1), np.concatenate([close, sims], 1)
        ids = np.where(np.isfinite(sims), ids, -1)
        chosen = self._diverse(nodes, ids, sims, links.shape[1])
        links[nodes] = chosen
        # The other direction: nodes that gain links choose again among old and new ones.
        source = np.repeat(nodes, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        close = np.einsum("ij,ij->i", self.vectors[target], self.vectors[source]) + self.bias[source]
        by = np.lexsort((-close, target))
        source, target = source[by], target[by]
        gained, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        new = np.full((len(gained), int(min(count.max(), 24))), -1, np.int32)
        fits = place < new.shape[1]
        new[np.repeat(np.arange(len(gained)), count)[fits], place[fits]] = source[fits]
        both = np.concatenate([links[gained], new], 1)
        for at in range(0, len(gained), BATCH):
            part, mine = both[at:at + BATCH], gained[at:at + BATCH]
            part = self._unique(part)
            sims = np.einsum("ijk,ik->ij", self.vectors[part], self.vectors[mine]) + self.bias[part]
            sims = np.where((part >= 0) & (part != mine[:, None]), sims, -np.inf)
            links[mine] = self._diverse(mine, np.where(np.isfinite(sims), part, -1), sims, links.shape[1])

    @staticmethod
    def _unique(ids: np.ndarray) -> np.ndarray:
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        return ids

    def _diverse(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each node up to ``most`` candidates, nearest first, passing over those nearer to a chosen one
        than to the node; free places then go to the nearest that were passed over."""
        out = np.full((len(ids), most), -1, np.int32)
        if not ids.shape[1]:
            return out
        order = np.argsort(-sims, axis=1, kind="stable")[:, :EF_BUILD + 16]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = ids >= 0
        x = self.vectors[ids]
        between = np.matmul(x, x.transpose(0, 2, 1)) + self.bias[ids][:, None, :]
        to_node = np.einsum("ijk,ik->ij", x, self.vectors[nodes]) + self.bias[nodes][:, None]
        keep = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            blocked = (keep & (between[:, j, :] > to_node[:, j, None])).any(1)
            keep[:, j] = valid[:, j] & ~blocked & (keep.sum(1) < most)
        rank = np.argsort(np.where(keep, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        out[:, :rank.shape[1]] = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        return out

    # ----------------------------------------------------------- searching

    def _walk(self, layers: list[np.ndarray], k: int, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.zeros((len(q), 1), np.int64)  # node 0 is in every layer
        for upper in range(len(layers) - 1, k, -1):
            start = self._beam(layers[upper], q, start, 4)[0]
        return self._beam(layers[k], q, start, ef)

    def _beam(self, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest nodes found with a beam of ``ef``: ids (-1: none) and closeness, nearest first."""
        count, n = len(q), len(self.vectors)
        ef = max(1, ef)
        seen = np.zeros((count, n), bool)
        safe = np.maximum(start, 0)
        sims = np.einsum("ijk,ik->ij", self.vectors[safe], q) + self.bias[safe]
        sims = np.where(start >= 0, sims, -np.inf)
        seen[np.nonzero(start >= 0)[0], start[start >= 0]] = True
        ids = np.full((count, ef), -1, np.int64)
        close = np.full((count, ef), -np.inf, np.float32)
        done = np.zeros((count, ef), bool)
        take = np.argsort(-sims, axis=1)[:, :ef]
        ids[:, :take.shape[1]] = np.take_along_axis(start, take, 1)
        close[:, :take.shape[1]] = np.take_along_axis(sims, take, 1)
        live = np.arange(count)
        while len(live):
            waiting = ~done[live] & (ids[live] >= 0)
            going = waiting.any(1)
            live, waiting = live[going], waiting[going]
            if not len(live):
                break
            pick = waiting.argmax(1)  # the beam is sorted: the nearest that waits
            done[live, pick] = True
            near = links[ids[live, pick]].astype(np.int64)
            fresh = near >= 0
            near = np.where(fresh, near, 0)
            fresh &= ~seen[live[:, None], near]
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            sims = np.einsum("ijk,ik->ij", self.vectors[near], q[live]) + self.bias[near]
            sims = np.where(fresh, sims, -np.inf)
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
            all_close = np.concatenate([close[live], sims], 1)
            all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
            best = np.argsort(-all_close, axis=1, kind="stable")[:, :ef]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            close[live] = np.take_along_axis(all_close, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1)
        ids[~np.isfinite(close)] = -1
        return ids, close

    def nearest(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and closeness of the beam of each query, nearest first."""
        q = np.ascontiguousarray(q, np.float32)
        if not len(self.vectors):
            return np.full((len(q), 1), -1, np.int64), np.full((len(q), 1), -np.inf, np.float32)
        return self._walk(self.layers, 0, q, min(ef, len(self.vectors)))

    def within(self, q: np.ndarray, least: np.ndarray, ef: int,
               beam: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All nodes found at least as close as each query's ``least``: query rows, nodes, closeness.

        The beam leads into the neighbourhood; from its members the walk goes on over every node that is close
        enough, so the number of results is not tied to the beam. ``beam``: what ``nearest`` gave for these queries.
        """
        q = np.ascontiguousarray(q, np.float32)
        ids, close = beam or self.nearest(q, ef)
        good = (ids >= 0) & (close >= least[:, None])
        row, col = np.nonzero(good)
        rows, nodes, sims = [row], [ids[row, col]], [close[row, col]]
        seen = np.zeros((len(q), len(self.vectors)), bool)
        seen[np.nonzero(ids >= 0)[0], ids[ids >= 0]] = True
        at = (row, ids[row, col])
        links = self.layers[0] if self.layers else np.empty((0, 1), np.int32)
        while len(at[0]):
            row = np.repeat(at[0], links.shape[1])
            node = links[at[1]].ravel().astype(np.int64)
            row, node = row[node >= 0], node[node >= 0]
            new = ~seen[row, node]
            flat = np.unique(row[new] * len(self.vectors) + node[new])
            row, node = np.divmod(flat, len(self.vectors))
            seen[row, node] = True
            sim = np.empty(len(row), np.float32)
            for a in range(0, len(row), 1 << 16):
                b = slice(a, a + (1 << 16))
                sim[b] = np.einsum("ij,ij->i", self.vectors[node[b]], q[row[b]]) + self.bias[node[b]]
            ok = sim >= least[row]
            at = (row[ok], node[ok])
            rows.append(at[0])
            nodes.append(at[1])
            sims.append(sim[ok])
        return np.concatenate(rows), np.concatenate(nodes), np.concatenate(sims)

    # ------------------------------------------------------------- storing

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, euclidean=np.array(self.euclidean),
                 **{f"layer{k}": x for k, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Graph:
        with np.load(io.BytesIO(blob), allow_pickle=False) as f:
            layers = [f[f"layer{k}"] for k in range(len(f.files) - 2)]
            return cls(f["vectors"], bool(f["euclidean"]), layers)
