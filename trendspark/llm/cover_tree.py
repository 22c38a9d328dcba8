"""Exact top-k inner product search with dual cover trees.

Rows and queries are dealt into blocks of bounded size by a hash. Each pair of a row block and
a query block is one group of a cogrouped task, which builds a cover tree of either side and
walks both together: a pair of nodes is cut when the largest inner product that its centres and
covering radii allow is below the worst kth score of the query node. The k best of each block
pair go to one window for each query, which keeps k rows for each query on the map side, too.

Scale: work is queries x rows at worst, as for any exact search, in independent pieces of
``block_rows`` x ``query_rows``; each row is sent once for each query block and each query once
for each row block. No side is broadcast and no group grows with the data: rows are counted by id
and vector first, and of those that repeat one row k copies are sent, which is all that a list of
k can hold.

Results: components x become floor(scale * x), as 64-bit integers (saturating), and scores are
exact integers as long as they fit in 64 bits (beyond, they saturate). Vectors that are null or
hold null or non-finite components, and rows without an id, take no part. Vectors of different
length are never compared. Ties go to the smaller id. Rows with the query's id are no candidates
of it. Each different (id, vector) row is a query of its own; repeated candidate rows count each.
Fewer candidates than k give fewer rows; empty tables give an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SCALE, BLOCK_ROWS, QUERY_ROWS = 5, 256, 4096, 4096
LEAF, STEP = 24, 1.6
CENTERS, FIRST, POINTS = 256, 128, 1024  # taken at a time: centres of a cover, first and later nodes of a comparison
LONG = np.iinfo(np.int64)


class CoverTree:
    """Nodes with a centre that is one of their points and the radius that covers them.

    The children of a node are a greedy cover of its points by balls of the node's scale, whose
    centres are more than the scale apart; the scale shrinks by ``STEP`` from level to level.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.zeros(0, np.int64)
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(points):
            self._grow(np.arange(len(points)))
        self.centers = points[self.center]
        self.norms = np.sqrt((self.centers**2).sum(axis=1))
        self.radii = np.array(self.radius)

    def _cover(self, own: np.ndarray, scale: float) -> list[np.ndarray]:
        """Greedy balls around the first point that is left; distances are taken ``CENTERS`` points at a time."""
        parts, rest = [], own
        while len(rest):
            points = self.points[rest]
            square = (points**2).sum(axis=1)
            near = square[:CENTERS, None] + square - 2 * (points[:CENTERS] @ points.T) <= scale * scale
            free = np.ones(len(rest), bool)
            for i in range(len(near)):
                if free[i]:
                    mine = near[i] & free
                    mine[i] = True
                    parts.append(rest[mine])
                    free &= ~mine
            rest = rest[free]
        return parts

    def _node(self, own: np.ndarray) -> tuple[int, np.ndarray]:
        far = np.sqrt(((self.points[own] - self.points[own[0]]) ** 2).sum(axis=1))
        self.center.append(int(own[0]))
        self.radius.append(float(far.max()))
        self.children.append([])
        self.members.append(own)
        return len(self.center) - 1, far

    def _grow(self, everything: np.ndarray) -> None:
        top, _ = self._node(everything)
        todo = [(top, self.radius[top] / STEP)]
        while todo:
            node, scale = todo.pop()
            own = self.members[node]
            if len(own) <= LEAF or not self.radius[node]:
                continue
            parts = self._cover(own, scale)
            if len(parts) == 1:
                todo.append((node, scale / STEP))
                continue
            for part in parts:
                child, _ = self._node(part)
                self.children[node].append(child)
                todo.append((child, min(scale, self.radius[child]) / STEP))


class Search:
    """One walk of a query tree against a data tree; ``score`` and ``found`` hold the ``count``
    best scores of each query and their ids, in order."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
        # of equal rows only the k + 1 smallest ids, and k rows of each, can be found: one of the ids may be the query's own
        by = np.lexsort((ids, *rows.T[::-1])) if rows.shape[1] else np.argsort(ids, kind="stable")
        rows, ids = rows[by], ids[by]
        if len(ids):
            at = np.arange(len(ids))
            new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
            new_id = new | np.append(True, ids[1:] != ids[:-1])
            since = lambda start: at - np.maximum.accumulate(np.where(start, at, 0))
            different = np.cumsum(new_id)
            nth_id = different - different[at - since(new)]
            some = (nth_id <= k) & (since(new_id) < k)
            rows, ids = rows[some], ids[some]
        self.ids, self.q_exact, self.r_exact = ids, queries, rows
        self.q, self.r = queries.astype(float), rows.astype(float)
        most = max((float(np.abs(x).max()) if x.size else 0.0) for x in (self.q, self.r))
        self.plain = most * most * max(1, rows.shape[1]) < 2**53
        self.query_ids, self.k = query_ids, k
        self.score = np.zeros((len(queries), k), np.int64)
        self.found = np.zeros((len(queries), k), np.int64)
        self.count = np.zeros(len(queries), np.int64)
        self.worst = np.full(len(queries), LONG.min)
        self.qt, self.rt = CoverTree(self.q), CoverTree(self.r)
        self.leaf = np.array([not c for c in self.rt.children], bool)
        if len(queries) and len(rows):
            self.walk(0, np.array([0]), self.limits([0], np.array([0]))[0])

    def limits(self, asked: list[int], nodes: np.ndarray) -> np.ndarray:
        """Largest inner product that a point below each query node and one below each data node can have."""
        qt, rt = self.qt, self.rt
        middle = qt.centers[asked] @ rt.centers[nodes].T
        more = qt.radii[asked][:, None] * rt.norms[nodes] + rt.radii[nodes] * (qt.norms[asked] + qt.radii[asked])[:, None]
        return np.maximum(middle + more + 1e-9 * (np.abs(middle) + more) + 1e-6, float(LONG.min))

    def walk(self, q: int, nodes: np.ndarray, limit: np.ndarray) -> None:
        """``nodes``: data nodes that still count for the query node ``q``, with their limits."""
        own, most = self.qt.members[q], FIRST
        while True:
            keep = limit >= self.worst[own].min()  # on a tie a smaller id may still come
            nodes, limit = nodes[keep], limit[keep]
            if not len(nodes):
                return
            if self.qt.children[q]:
                finer = ~self.leaf[nodes] & (self.rt.radii[nodes] > self.qt.radii[q])
                grown = np.append(nodes[~finer], self.below(nodes[finer]))
                todo = self.qt.children[q]
                for at in range(0, len(todo), CENTERS):
                    some = todo[at : at + CENTERS]
                    for child, its in zip(some, self.limits(some, grown), strict=True):
                        self.walk(child, grown, its)
                return
            if len(nodes) > most:
                order = np.argpartition(limit, -most)
                now, nodes, limit = nodes[order[-most:]], nodes[order[:-most]], limit[order[:-most]]
            else:
                now, nodes, limit = nodes, nodes[:0], limit[:0]
            most = POINTS  # the first ones raise the worst score that the others must reach
            ready = now[self.leaf[now]]
            for at in range(0, len(ready), POINTS):
                self.compare(own, np.concatenate([self.rt.members[i] for i in ready[at : at + POINTS].tolist()]))
            if len(ready) < len(now):
                finer = self.below(now[~self.leaf[now]])
                nodes, limit = np.append(nodes, finer), np.append(limit, self.limits([q], finer)[0])

    def below(self, nodes: np.ndarray) -> np.ndarray:
        return np.array([c for n in nodes.tolist() for c in self.rt.children[n]], np.int64)

    def compare(self, own: np.ndarray, points: np.ndarray) -> None:
        """Scores of some queries with some points; each query keeps its k best."""
        for at in range(0, len(own), CENTERS):
            self._compare(own[at : at + CENTERS], points)

    def _compare(self, own: np.ndarray, points: np.ndarray) -> None:
        if self.plain:
            scores = (self.q[own] @ self.r[points].T).astype(np.int64)
        else:
            exact = self.q_exact[own].astype(object) @ self.r_exact[points].astype(object).T
            scores = np.clip(exact, LONG.min, LONG.max).astype(np.int64)
        mine = self.ids[points] == self.query_ids[own][:, None]
        scores[mine] = LONG.min
        floor = self.worst[own]
        if len(points) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(points) - self.k, axis=1)[:, len(points) - self.k])
        a, b = np.nonzero((scores >= floor[:, None]) & ~mine)
        had, place = np.nonzero(np.arange(self.k) < self.count[own][:, None])
        at = np.append(a, had)
        score = np.append(scores[a, b], self.score[own[had], place])
        ids = np.append(self.ids[points[b]], self.found[own[had], place])
        order = np.lexsort((ids, ~score, at))  # ~x falls as x rises, also at the ends of 64 bits
        at, score, ids = at[order], score[order], ids[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        best = nth < self.k
        at, nth, q = at[best], nth[best], own[at[best]]
        self.score[q, nth], self.found[q, nth] = score[best], ids[best]
        self.count[own] = np.bincount(at, minlength=len(own))
        full = own[self.count[own] == self.k]
        self.worst[full] = self.score[full, self.k - 1]


def _blocks(rows: int, most: int) -> int:
    return max(1, -(-rows // most))


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the rows that take part, with integer components."""
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x")).where("vec_id is not null and x is not null")
    finite = known.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))))
    return finite.select("vec_id", F.transform("x", lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("v"))


def at_most(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with at most k copies of each (vec_id, v), counted on the map side first."""
    counted = rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)))).alias("nth"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows of ``vectors`` (vec_id, embedding) where
    ``is_query`` holds (a condition on vec_id), the k other rows with the largest inner product."""
    rows = integer_vectors(vectors, scale)
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(is_query, 1)).alias("queries")).first()
    data_blocks, query_blocks = _blocks(n["rows"], block_rows), _blocks(n["queries"], query_rows)
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    few = at_most(rows, k)
    data = few.select(spread(data_blocks).alias("d"), every(query_blocks).alias("q"), "vec_id", "v")
    asked = few.where(is_query).where("nth = 1").select(every(data_blocks).alias("d"), spread(query_blocks).alias("q"), "vec_id", "v")

    def pair(key, left, right):
        import pandas as pd

        found = []
        for size, ask in right.groupby(right["v"].map(len)):
            have = left[left["v"].map(len) == size]
            if not len(have):
                continue
            as_rows = lambda f, size=size: np.array([np.asarray(v, np.int64) for v in f["v"]], np.int64).reshape(len(f), size)
            asked = np.unique(np.column_stack([ask["vec_id"].to_numpy(np.int64), as_rows(ask)]), axis=0)
            ids, vectors = asked[:, 0], asked[:, 1:]
            search = Search(vectors, ids, as_rows(have), have["vec_id"].to_numpy(np.int64), k)
            found += [(int(i), v.tobytes(), int(vec), int(s)) for i, v, n, scores, best in zip(ids, vectors, search.count, search.score, search.found, strict=True) for s, vec in zip(scores[:n], best[:n], strict=True)]
        return pd.DataFrame(found, columns=["query_id", "vector", "vec_id", "score"])

    near = data.groupBy("d", "q").cogroup(asked.groupBy("d", "q")).applyInPandas(pair, "query_id long, vector binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
