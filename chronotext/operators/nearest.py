"""Exact nearest document by Jensen-Shannon divergence, without comparing all pairs.

Two bounds spare most of the work. The square root of the divergence is a metric, so distances to
a few fixed pivots bound the distance between any two documents: training documents are put into areas by
nearest pivot and by how far they lie from it, and each query visits only the areas whose bound is
within its distance to the nearest document known so far. Areas are joined to a bounded number of groups, and a query
is sent at most once to each group, so what is shuffled grows as the queries and the documents. And the divergence is at most the squared
Hellinger distance and at least ln 2 times it, in each component and so in sum. That distance is half the squared
distance between the square roots, so a group is divided into leaves of near documents, each with the box that holds it, and a chunk of near queries
meets only the leaves whose boxes it can reach: one matrix product in single precision for some leaves at a time. Logarithms, in double precision,
are worked out only for pairs that can still be nearest.
"""

from __future__ import annotations

import sys
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from chronotext.session import materialize

# The functions below travel with the tasks, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bounds of the search. Pivots, rings and groups are fewer for fewer documents. There are GROUPS groups until
# they would hold more than GROUP_ROWS documents each; a task gets one group and at most
# CHUNK_ROWS * CHUNKS_PER_COPY of its queries, and compares a chunk with a block of an area at a time.
PIVOTS = 256
RINGS = 16
SAMPLE = 16_384
GROUPS = 32
GROUP_ROWS = 131_072
BLOCK_ROWS = 1024
CHUNK_ROWS = 256
GROWTH = 8
LEAF_ROWS = 128
CHUNKS_PER_COPY = 512
PAIRS_AT_ONCE = 100_000
SLACK = 1e-6
TIE_SLACK = 1e-9
# What sums of single precision may be off by, for roots of length 1.
SINGLE_SLACK = 1e-5


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence of each row of ``p`` with the same row of ``q``."""
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log(p / middle), 0.0)
        right = np.where(q > 0, q * np.log(q / middle), 0.0)
    return (left + right).sum(axis=1) / 2


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return np.einsum("...k,...k->...", x, np.log(x))


def all_divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Divergence of every row of ``p`` with every row of ``q``, to about 1e-12."""
    # The offset keeps the logarithm finite and is lost in every other sum.
    half_p, half_q = p / 2 + 1e-300, q / 2
    own = (_x_log_x(p + 1e-300)[:, None] + _x_log_x(q + 1e-300)[None, :]) / 2
    step = max(1, 400_000 // max(1, q.size))
    for start in range(0, len(p), step):
        rows = slice(start, start + step)
        own[rows] -= _x_log_x(half_p[rows, None, :] + half_q[None, :, :])
    return np.maximum(own, 0.0)


def _matrix(thetas: pd.Series) -> np.ndarray:
    return np.array(thetas.to_list(), dtype=float)


def hellinger(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared Hellinger distance of every row of ``p`` with every row of ``q``."""
    squares = (p.sum(axis=1)[:, None] + q.sum(axis=1)[None, :]) / 2 - np.sqrt(p) @ np.sqrt(q).T
    return np.maximum(squares, 0.0)


def _pair_divergences(p: np.ndarray, row: np.ndarray, q: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Divergence of the named pairs of rows, a limited number of pairs at a time."""
    parts = [slice(i, i + PAIRS_AT_ONCE) for i in range(0, len(row), PAIRS_AT_ONCE)]
    return np.concatenate([np.empty(0), *(divergences(p[row[part]], q[column[part]]) for part in parts)])


def nearest_bound(queries: np.ndarray, train: np.ndarray) -> np.ndarray:
    """A divergence that the nearest row of ``train`` does not exceed: that of the Hellinger-nearest one."""
    # In single precision another row may be taken, which is a bound too.
    roots, asked = np.sqrt(train).astype(np.float32), np.sqrt(queries).astype(np.float32)
    half = train.sum(axis=1).astype(np.float32) / 2
    return divergences(queries, train[(half - asked @ roots.T).argmin(axis=1)])


def possible_pairs(queries: np.ndarray, train: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query row, training row) of all pairs whose divergence may be the query's least and within its ``limit``."""
    apart = hellinger(queries, train)
    limit = np.minimum(limit, divergences(queries, train[apart.argmin(axis=1)]))
    return np.nonzero(np.log(2) * apart <= limit[:, None] + TIE_SLACK)


def _leaves(train: np.ndarray, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(leaves, order): rows of ``train`` that stand together, at most ``LEAF_ROWS`` each, and the queries by the leaf they would be in."""
    stack, leaves, order = [(np.arange(len(train)), np.arange(len(queries)))], [], []
    while stack:
        rows, asked = stack.pop()
        if len(rows) <= LEAF_ROWS:
            leaves.append(rows)
            order.append(asked)
            continue
        own = train[rows]
        axis = int(own.var(axis=0).argmax())
        half = np.argpartition(own[:, axis], len(rows) // 2)
        below = queries[asked, axis] < own[half[len(rows) // 2], axis]
        stack += [(rows[half[len(rows) // 2 :]], asked[~below]), (rows[half[: len(rows) // 2]], asked[below])]
    return leaves, np.concatenate(order)


def _to_boxes(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every query from every box."""
    total, outside = np.zeros((len(queries), len(low)), np.float32), np.empty((len(queries), len(low)), np.float32)
    for axis in range(queries.shape[1]):
        at = queries[:, axis, None]
        np.maximum(low[:, axis] - at, at - high[:, axis], out=outside)
        np.maximum(outside, 0, out=outside)
        outside *= outside
        total += outside
    return total


def _thetas(table: pa.Table) -> np.ndarray:
    cells = table["theta"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return cells.reshape(table.num_rows, -1)


def search_group(queries: pa.Table, train: pa.Table) -> pa.Table:
    """(id, js, train_id, year): the best row of one group for each query that has one within its ``limit``.

    ``queries`` has (id, theta, limit), ``train`` (id, year, theta). The leaves that are nearest on the whole come first and
    lower the limits for the others. Ties go to the least id.
    """
    if not queries.num_rows or not train.num_rows:
        empty = pa.array([], pa.int64())
        return pa.table({"id": empty, "js": pa.array([], pa.float64()), "train_id": empty, "year": pa.array([], pa.int32())})
    thetas, asked = _thetas(train), _thetas(queries)
    # Turned so that the documents spread along the axes, which narrows the boxes.
    roots, asked_roots = np.sqrt(thetas), np.sqrt(asked)
    middle = roots.mean(axis=0)
    turn = np.linalg.eigh((roots - middle).T @ (roots - middle))[1][:, ::-1]
    roots, asked_roots = (((x - middle) @ turn).astype(np.float32) for x in (roots, asked_roots))
    leaves, by_leaf = _leaves(roots, asked_roots)
    low, high = (np.stack([f(roots[rows], axis=0) for rows in leaves]) for f in (np.min, np.max))
    size = np.array([len(rows) for rows in leaves])
    starts, rows = np.cumsum(size) - size, np.concatenate(leaves)
    thetas, train = thetas[rows], train.take(pa.array(rows))
    order = train["id"].combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
    # The product of these is the squared distance.
    norms, asked_norms = (np.einsum("ij,ij->i", x, x)[:, None] for x in (roots, asked_roots))
    right = np.hstack([roots, norms, np.ones_like(norms)])[rows]
    left = np.hstack([-2 * asked_roots, np.ones_like(asked_norms), asked_norms])
    slack = SINGLE_SLACK * max(1.0, float(norms.max()), float(asked_norms.max()))
    limits = queries["limit"].to_numpy().copy()
    js, at = np.full(len(asked), np.inf), np.full(len(asked), -1)

    def reach(some: np.ndarray) -> np.ndarray:
        """How far, squared, a document of each query's divergence can be."""
        return ((2 / np.log(2)) * (limits[some] + TIE_SLACK) + slack).astype(np.float32)[:, None]

    for begin in range(0, len(asked), CHUNK_ROWS):
        chunk = by_leaf[begin : begin + CHUNK_ROWS]
        # The box of the chunk first, then its queries.
        least, most = asked_roots[chunk].min(axis=0), asked_roots[chunk].max(axis=0)
        between = np.square(np.maximum(np.maximum(low - most, least - high), 0)).sum(axis=1)
        near = np.flatnonzero(between <= reach(chunk).max())
        to_leaf = _to_boxes(asked_roots[chunk], low[near], high[near])
        todo = np.flatnonzero((to_leaf <= reach(chunk)).any(axis=0))
        todo, done = todo[np.argsort(to_leaf[:, todo].mean(axis=0), kind="stable")], 0
        while done < len(todo):
            # The first leaves lower the limits, then come more at a time.
            first, block = not done, BLOCK_ROWS * GROWTH if done else BLOCK_ROWS
            some = todo[done : done + max(1, block // LEAF_ROWS)]
            done += len(some)
            wanted = to_leaf[:, some] <= reach(chunk)
            own, some = chunk[wanted.any(axis=1)], near[some[wanted.any(axis=0)]]
            if not len(own):
                continue
            column = np.arange(size[some].sum()) + np.repeat(starts[some] - np.cumsum(size[some]) + size[some], size[some])
            apart = left[own] @ right[column].T
            if first:
                limits[own] = np.minimum(limits[own], divergences(asked[own], thetas[column[apart.argmin(axis=1)]]))
            row, found = np.divmod(np.flatnonzero(apart <= reach(own)), len(column))
            found = column[found]
            exact = _pair_divergences(asked[own], row, thetas, found)
            by = np.lexsort((order[found], exact, row))
            row, best = np.unique(row[by], return_index=True)
            row, found, exact = own[row], found[by[best]], exact[by[best]]
            better = (exact < js[row]) | (exact == js[row]) & (order[found] < order[at[row]])
            row, found, exact = row[better], found[better], exact[better]
            js[row], at[row] = exact, found
            limits[row] = np.minimum(limits[row], exact)
    has = np.flatnonzero(at >= 0)
    best = train.select(["id", "year"]).take(at[has])
    return pa.table({"id": queries["id"].take(has), "js": js[has], "train_id": best["id"], "year": best["year"]})


def nearest_document(queries: DataFrame, training: DataFrame) -> DataFrame:
    """(id, js, train_id, year): the training document least divergent from each query.

    ``queries`` has (id, theta), ``training`` (id, year, theta); ids are numbers. Equal divergence
    goes to the lowest training id. Thetas without any weight are no distributions and are left
    out on both sides.
    """
    has_weight = F.exists("theta", lambda cell: cell > 0)
    # Copies of one theta become one row before anything is compared. The filter comes after the
    # write, where it cannot be pushed down and make the thetas be computed twice.
    train = materialize(
        training.groupBy("theta")
        .agg(F.min(F.struct("id", "year")).alias("first"))
        .select("first.id", "first.year", "theta")
    ).where(has_weight)
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = train.count()
    n_groups = max(min(GROUPS, -(-total // BLOCK_ROWS)), -(-total // GROUP_ROWS))
    n_pivots = min(PIVOTS, -(-total // BLOCK_ROWS))
    n_rings = min(RINGS, -(-total // (BLOCK_ROWS * PIVOTS)))
    # A bounded sample of training documents; the first of them are the pivots.
    n_sample = max(n_pivots, min(SAMPLE, total // 64))
    sample_rows = train.orderBy(F.xxhash64("id"), "id").limit(n_sample).collect()
    if not sample_rows:
        return queries.limit(0).selectExpr(
            "id", "cast(null as double) js", "cast(null as bigint) train_id", "cast(null as int) year"
        )
    sample = np.array([row.theta for row in sample_rows], dtype=float)
    pivots = sample[:n_pivots]

    @F.pandas_udf("area int, distance double")
    def place(thetas: pd.Series) -> pd.DataFrame:
        distance = np.sqrt(all_divergences(np.nan_to_num(_matrix(thetas)), pivots))
        cell = distance.argmin(axis=1)
        nearest = distance[np.arange(len(cell)), cell]
        return pd.DataFrame({"area": cell * n_rings + (nearest * n_rings).astype(int), "distance": nearest})

    placed = materialize(
        train.withColumn("at", place("theta")).select(F.col("id").cast("long").alias("id"), F.col("year").cast("int").alias("year"), "theta", "at.*")
    )
    # At most PIVOTS * (RINGS + 1) rows, whatever the input.
    areas = (
        placed.groupBy("area")
        .agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
        .toPandas()
        .sort_values("area", ignore_index=True)
    )
    cell, low, high = areas["area"].to_numpy() // n_rings, areas["low"].to_numpy(), areas["high"].to_numpy()
    # Documents stand in order of their areas, by hash within an area, and are cut into groups of equal size.
    areas["start"] = areas["n"].cumsum() - areas["n"]
    group_rows = -(-total // n_groups)
    first_group = areas["start"].to_numpy() // group_rows
    last_group = (areas["start"] + areas["n"] - 1).to_numpy() // group_rows
    numbers = np.arange(n_groups)
    from_area, to_area = np.searchsorted(last_group, numbers), np.searchsorted(first_group, numbers, side="right")

    @F.pandas_udf("limit double, groups array<int>")
    def reach(thetas: pd.Series) -> pd.DataFrame:
        """How far each query must look, and the groups to visit."""
        out = []
        for start in range(0, len(thetas), 256):
            queries = np.nan_to_num(_matrix(thetas[start : start + 256]))
            limits = nearest_bound(queries, sample)
            distance = np.sqrt(all_divergences(queries, pivots))
            home = distance.min(axis=1)
            to_cell = distance[:, cell]
            bound = np.maximum.reduce([to_cell - high, low - to_cell, (to_cell - home[:, None]) / 2])
            need = np.cumsum(bound <= np.sqrt(limits)[:, None] + SLACK, axis=1)
            need = np.pad(need, ((0, 0), (1, 0)))
            visits = need[:, to_area] > need[:, from_area]
            out += [(limit, np.flatnonzero(row)) for limit, row in zip(limits, visits)]
        return pd.DataFrame(out, columns=["limit", "groups"])

    asked = materialize(
        queries.select(F.col("id").cast("long").alias("id"), "theta", reach("theta").alias("at")).select("id", "theta", "at.*")
    ).where(has_weight)
    # A group wanted by very many queries is copied, so that no task gets all of them. One row per group.
    copies = (
        asked.select(F.explode("groups").alias("group"))
        .groupBy("group")
        .agg(F.ceil(F.count(F.lit(1)) / (CHUNK_ROWS * CHUNKS_PER_COPY)).cast("int").alias("copies"))
    )
    copies = F.broadcast(materialize(copies))
    layout = F.broadcast(queries.sparkSession.createDataFrame(areas[["area", "start", "n"]], "area int, start bigint, n bigint"))
    place_in_order = F.col("start") + F.pmod(F.xxhash64("id"), F.col("n"))
    documents = (
        placed.join(layout, "area")
        .withColumn("group", F.floor(place_in_order / group_rows).cast("int"))
        .join(copies, "group")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .select("group", "copy", "id", "year", "theta")
    )
    visits = (
        asked.select("id", "theta", "limit", F.explode("groups").alias("group"))
        .join(copies, "group")
        .select("group", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int").alias("copy"), "id", "theta", "limit")
    )

    best = F.min(F.struct("js", "train_id", "year")).alias("best")
    # Little data but much work per row: a fixed number of partitions, which is not coalesced.
    place_of = ["group", "copy"]
    return (
        visits.repartition(tasks, *place_of)
        .groupBy(*place_of)
        .cogroup(documents.repartition(tasks, *place_of).groupBy(*place_of))
        .applyInArrow(search_group, "id long, js double, train_id long, year int")
        .groupBy("id")
        .agg(best)
        .select("id", "best.js", "best.train_id", "best.year")
    )
