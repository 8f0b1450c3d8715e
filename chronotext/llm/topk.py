"""Exact top-k by inner product: dual-tree search with a cover tree on queries and on data."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronotext.llm.vectors import matrix, usable, widened
from chronotext.session import materialize

#: Rows of a block of queries and of a block of data; a task holds one of each.
QUERY_BLOCK, DATA_BLOCK = 1024, 8192
#: Points of a leaf. Queries are kept in smaller groups, since a group is as demanding as its worst query.
LEAF, QUERY_LEAF = 512, 64
SCALE = 1024
_EXACT = float(1 << 53)


class CoverTree:
    """Nested balls: each child's centre is a point, and all its points lie within its covering radius.

    A node of covering radius r is cut into children around points that are more than r / 2 apart,
    taken farthest first, so that children cover at half the scale. Identical points, and nodes of
    ``leaf`` points or fewer, are leaves. ``points[low:high]`` are the points of a node.
    """

    FANOUT = 16

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        self.order = np.arange(len(points))
        self.nodes: list[tuple[np.ndarray, float, int, int, list[int]]] = []
        self.points = points
        if len(points):
            self._build()
        self.points = points[self.order]
        self.norms = [float(np.sqrt((n[0] ** 2).sum())) for n in self.nodes]

    def _build(self) -> None:
        def node(low: int, high: int, center: int) -> int:
            own = self.points[self.order[low:high]]
            radius = float(np.sqrt(((own - self.points[center]) ** 2).sum(1).max()))
            self.nodes.append((self.points[center], radius, low, high, []))
            return len(self.nodes) - 1

        waiting = [node(0, len(self.order), int(self.order[0]))]
        while waiting:
            number = waiting.pop()
            _, radius, low, high, children = self.nodes[number]
            if high - low <= self.leaf or radius == 0:
                continue
            own = self.order[low:high].copy()
            x = self.points[own]
            centers, owner = [0], np.zeros(len(own), dtype=np.int64)
            nearest = ((x - x[0]) ** 2).sum(1)
            while len(centers) < self.FANOUT and nearest.max() > (radius / 2) ** 2:
                far = int(nearest.argmax())
                d = ((x - x[far]) ** 2).sum(1)
                closer = d < nearest
                owner[closer], nearest = len(centers), np.minimum(nearest, d)
                centers.append(far)
            if len(centers) == 1:
                continue
            by_owner = np.argsort(owner, kind="stable")
            self.order[low:high] = own[by_owner]
            ends = np.searchsorted(owner[by_owner], np.arange(len(centers) + 1)) + low
            for i, center in enumerate(centers):
                children.append(node(int(ends[i]), int(ends[i + 1]), int(own[center])))
            waiting += children


class Best:
    """The k best (score, id) of each query, larger scores first, then smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, rows: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        useful = (scores >= self.scores[rows, -1:]).any(0)
        scores, ids = scores[:, useful], ids[useful]
        if not len(ids):
            return
        scores = np.hstack([self.scores[rows], scores])
        ids = np.hstack([self.ids[rows], np.broadcast_to(ids, (len(scores), len(ids)))])
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, order, 1)
        self.ids[rows] = np.take_along_axis(ids, order, 1)

    def worst(self, rows: slice) -> float:
        """The score that a point must reach to matter to any query of the group."""
        return float(self.scores[rows, -1].min())


def dual_tree_search(query_points, query_ids, data_points, data_ids, k: int, leaves=(QUERY_LEAF, LEAF)) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, pairs scored): for each query its k best points other than itself.

    A product of a query within r of q and a point within s of p is at most
    q.p + r|p| + s|q| + rs. Node pairs wait in a heap by that bound and are dropped when it is
    below the worst k-th score of the query node; a bound equal to it is followed, for ties.
    """
    query_points, data_points = widened(query_points, data_points)
    queries, data = CoverTree(query_points, leaves[0]), CoverTree(data_points, leaves[1])
    ids, own = data_ids[data.order], query_ids[queries.order]
    best, scored = Best(len(own), k), 0
    if not len(own) or not len(ids):
        return best.scores, best.ids, scored
    # Bounds are floats: a little is added so that rounding never drops a point.
    slack = 1e-9

    def bound(a: int, b: int) -> float:
        q, r = queries.nodes[a][:2]
        p, s = data.nodes[b][:2]
        top = float(q @ p) + r * data.norms[b] + s * queries.norms[a] + r * s
        return top + slack * (abs(top) + (queries.norms[a] + r) * (data.norms[b] + s) + 1)

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        negative, a, b = heapq.heappop(heap)
        _, r, low, high, split_queries = queries.nodes[a]
        _, s, first, last, split_data = data.nodes[b]
        if -negative < best.worst(slice(low, high)):
            continue
        if not split_queries and not split_data:
            scores = _products(queries.points[low:high], data.points[first:last])
            scored += scores.size
            scores = np.where(own[low:high, None] == ids[None, first:last], -np.inf, scores)
            best.offer(slice(low, high), scores, ids[first:last])
            continue
        if split_data and (s >= r or not split_queries):
            pairs = [(a, child) for child in split_data]
        else:
            pairs = [(child, b) for child in split_queries]
        for x, y in pairs:
            heapq.heappush(heap, (-bound(x, y), x, y))
    back = np.argsort(queries.order)
    return best.scores[back], best.ids[back], scored


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of integer vectors, exact: by floats while sums stay below 2**53, else by integers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < _EXACT:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.float64)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Best points of a block of data (left) for a block of queries (right)."""
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        query_ids, data_ids = right["query_id"].to_numpy(), left["vec_id"].to_numpy()
        scores, ids, _ = dual_tree_search(matrix(right["query_units"]), query_ids, matrix(left["units"]), data_ids, k)
        found = np.isfinite(scores)
        rows = np.repeat(np.arange(len(scores)), found.sum(1))
        return pa.table({"query_id": query_ids[rows], "vec_id": ids[found], "score": scores[found].astype(np.int64)})

    return run


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each query row.

    The score is the integer product of the vectors as floor(scale * x); ties go to the smaller id.
    Queries and data are dealt into blocks of bounded size by hash; each pair of a data
    block and a query block is one dual-tree search, which gives at most k rows a query, and the
    rows of a query are reduced to k in two steps. No group grows with the input.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id. A
    shorter vector counts as if filled with zeros, an empty one scores 0 with all. A row repeated with
    its id is one row. Queries with fewer than k others get all of them. Other columns are not read.
    """
    units = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    rows = usable(vectors).select("vec_id", units.alias("units")).groupBy("vec_id").agg(F.first("units").alias("units"))
    rows = materialize(rows.withColumn("is_query", F.coalesce(is_query, F.lit(False))))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    data_blocks, query_blocks = -(-counts["n"] // DATA_BLOCK) or 1, -(-counts["q"] // QUERY_BLOCK) or 1
    # Each row goes to the blocks by its id, and to every block of the other side.
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select(block(data_blocks).alias("d"), every(query_blocks).alias("q"), "vec_id", "units")
    queries = rows.where("is_query").select(every(data_blocks).alias("d"), block(query_blocks).alias("q"), F.col("vec_id").alias("query_id"), F.col("units").alias("query_units"))
    found = data.groupBy("d", "q").cogroup(queries.groupBy("d", "q")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    # A query meets one row of k from each data block: parts of 64 blocks first, then the rest.
    part = F.pmod(F.xxhash64("vec_id"), F.lit(-(-data_blocks // 64)))
    some = Window.partitionBy("query_id", "part").orderBy(*order)
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    final = Window.partitionBy("query_id").orderBy(*order)
    return (
        first.select("query_id", "vec_id", "score", F.row_number().over(final).alias("rank"))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
