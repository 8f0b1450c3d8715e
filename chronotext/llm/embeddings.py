"""Embedding near-duplicates: an inverted multi-index over both halves of the vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from chronotext.llm.common import binaries, join_small, lists
from chronotext.llm.components import connected_components, local_components
from chronotext.llm.vectors import matrix, usable, widened
from chronotext.session import materialize

#: Rows from which the codebooks are learned; all rows are indexed.
SAMPLE_ROWS = 20_000
CODEBOOK = 16
BLOCK = 1024


def learn_codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centres by k-means from farthest-first starts: the same result for the same rows."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    chosen, d = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < size and d.max() > 1e-12:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    centers = x[chosen]
    for _ in range(rounds):
        owner = distances(x, centers).argmin(1)
        sums, n = np.zeros_like(centers), np.bincount(owner, minlength=len(centers))
        np.add.at(sums, owner, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return np.unique(centers, axis=0)


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)


def crossings(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """How far each x is from the plane between its own cell and each other cell."""
    d = distances(x, centers)
    home = d.argmin(1)
    apart = np.sqrt(np.maximum(distances(centers, centers), 0))[home]
    # The slack is beyond the rounding of the distances, so that no cell seems farther than it is.
    gap = np.maximum(d - d[np.arange(len(x)), home][:, None] - 1e-12, 0)
    return gap / np.where(apart > 0, 2 * apart, np.inf)


class MultiIndex:
    """Codebooks of both halves, and how far the traversal of the product grid must go.

    The distances of both vectors of a pair from the planes between their cells add up to at most
    their distance in each half, so over both halves their squares to at most 2 - 2 * similarity,
    and one of the two has at most half of it. ``reach`` is the root of that half: of each pair that
    is as similar, at least one vector visits the cell of the other, whatever the vectors are.
    """

    def __init__(self, sample: np.ndarray, similarity: float, size: int = CODEBOOK):
        self.half = sample.shape[1] // 2
        self.books = [learn_codebook(part, size) for part in self._halves(sample)]
        self.reach = float(np.sqrt(max(1 - similarity, 0))) + 1e-9

    def _halves(self, x):
        return x[:, : self.half], x[:, self.half :]

    def homes(self, x) -> tuple[np.ndarray, np.ndarray]:
        return tuple(distances(part, book).argmin(1) for part, book in zip(self._halves(x), self.books))

    def cell(self, x) -> np.ndarray:
        first, second = self.homes(x)
        return first * len(self.books[1]) + second

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the grid cells of each row, nearest first, as far as ``reach``.

        Both halves' cells are sorted by their own distance; the pairs below the frontier of equal
        joint distance are those that a multi-sequence traversal reaches before it stops.
        """
        first, second = (crossings(part, book) for part, book in zip(self._halves(x), self.books))
        one, two = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
        a, b = np.take_along_axis(first, one, 1), np.take_along_axis(second, two, 1)
        rows, cells, costs = [], [], []
        for i in range(a.shape[1]):  # the i-th nearest cell of the first half, with a frontier in the second
            joint = np.hypot(a[:, i : i + 1], b)
            row, j = np.nonzero(joint <= self.reach)
            rows.append(row)
            cells.append(one[row, i] * len(self.books[1]) + two[row, j])
            costs.append(joint[row, j])
        rows, cells, costs = map(np.concatenate, (rows, cells, costs))
        order = np.lexsort((costs, rows))
        return rows[order], cells[order]


def _directions(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; a null vector stays null. Large components do not overflow."""
    x = x / np.maximum(np.abs(x).max(1, initial=0), 1e-300)[:, None]
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def _cells(index: MultiIndex):
    """Rows with their direction, home cell and the cells that they visit."""

    def run(batches):
        for batch in batches:
            x = _directions(matrix(batch.column(batch.schema.get_field_index("embedding")), index.half * 2))
            rows, cells = index.visits(x)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(batch.schema.get_field_index(c)) for c in ("label", "id", "copies")],
                    binaries(x.reshape(-1), np.arange(len(x) + 1) * x.shape[1]),
                    pa.array(index.cell(x).astype(np.int32)),
                    lists(cells.astype(np.int32), np.searchsorted(rows, np.arange(len(x) + 1))),
                ],
                ["label", "id", "copies", "direction", "cell", "cells"],
            )

    return run


def _repeated(group: pa.Table, hosts: np.ndarray, guests: np.ndarray, here: int) -> np.ndarray:
    """Which pairs are met on the guest's shelf as well and are left to it: the lower shelf has them."""
    shelves, place = np.unique(group["shelf"].to_numpy()[guests], return_inverse=True)
    seen = group["seen"].take(pa.array(hosts)).combine_chunks()
    owner, there = pc.list_parent_indices(seen).to_numpy(), pc.list_flatten(seen).to_numpy()
    known = np.isin(there, shelves[shelves < here])
    visited = np.zeros((len(hosts), len(shelves)), dtype=bool)
    visited[owner[known], np.searchsorted(shelves, there[known])] = True
    return visited[:, place]


def _verify(similarity: float):
    def run(group: pa.Table) -> pa.Table:
        """Links between the members of two blocks: (id, links, joined), ``joined`` a smaller id it is linked with."""
        ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
        side = group["side"].to_numpy()
        x = np.frombuffer(b"".join(group["direction"].to_pylist()), dtype=np.float64).reshape(len(ids), -1)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        near = x[left] @ x[right].T >= similarity
        same = bool((side == 2).any())
        if same:  # one block with itself: each pair once
            near &= left[:, None] < right[None]
        elif group["kind"][0].as_py() == 1 and near.any():
            near &= ~_repeated(group, left, right, group["at"][0].as_py())
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        joined = local_components(ids, a, b)
        some = links > 0
        return pa.table({"id": ids[some], "links": links[some].astype(np.int64), "joined": joined[some]})

    return run


def near_duplicates(vectors: DataFrame, similarity: float = 0.93, codebook: int = CODEBOOK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of equal, non-null labels are linked when their cosine is ``similarity`` or more.
    Equal vectors of a label become one row with its number of copies. Each row has a home cell of
    the product grid and visits the cells that the traversal reaches. The cells of a label, in order,
    fill shelves of about BLOCK rows, larger ones when a cell is large; a row goes to its own shelf and,
    once, to each other one with a cell that it visits. Shelves are cut into
    blocks of at most about BLOCK rows; every block of visitors meets every block of the shelf's own
    rows, is verified in double precision and gives one row per linked vector, not per pair. A pair
    whose vectors visit each other counts on the lower shelf only. No pair at the threshold is missed.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, have 0
    links and their own component; rows with a null vec_id are left out. Shorter vectors
    count as filled with zeros. A repeated vec_id is one row, of its greatest label and vector.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    named = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding", "label")
    named = materialize(named.groupBy("vec_id").agg(F.max(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding"))
    some = F.exists("embedding", lambda x: x != 0)
    able = usable(named, "label").where(F.col("label").isNotNull() & some)
    classes = materialize(able.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    sample = classes.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).select("embedding").toArrow()
    x = matrix(sample["embedding"])
    width = x.shape[1] + x.shape[1] % 2
    index = MultiIndex(_directions(np.pad(x, ((0, 0), (0, width - x.shape[1])))), similarity, codebook)
    kind = classes.schema["label"].dataType.simpleString()
    placed = classes.mapInArrow(_cells(index), f"label {kind}, id long, copies long, direction binary, cell int, cells array<int>")
    placed = materialize(placed)
    filled = placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("f"))
    before = lambda i: F.aggregate(F.slice("f", 1, i), F.lit(0).cast("long"), lambda total, c: total + c["n"])
    shelf = F.transform("f", lambda c, i: F.struct(c["cell"], F.floor(before(i) / BLOCK).cast("int")))
    shelves = materialize(filled.select("label", F.map_from_entries(shelf).alias("shelves")))
    seen = F.array_distinct(F.filter(F.transform("cells", lambda c: F.col("shelves")[c]), lambda s: s.isNotNull()))
    rows = join_small(placed, shelves, "label").select("label", "id", "copies", "direction", F.col("shelves")[F.col("cell")].alias("shelf"), seen.alias("seen"))
    rows = materialize(rows)
    away = F.explode(F.array_remove("seen", F.col("shelf"))).alias("at")
    sizes = rows.select("label", F.col("shelf").alias("at"), F.lit(True).alias("home")).unionByName(rows.select("label", away, F.lit(False).alias("home")))
    sizes = sizes.groupBy("label", "at").agg(
        (F.ceil(F.count_if("home") / BLOCK)).cast("int").alias("own"), (F.ceil(F.count_if(~F.col("home")) / BLOCK)).cast("int").alias("guests")
    )
    sizes = materialize(sizes)
    block = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1))
    own = join_small(rows.withColumn("at", F.col("shelf")), sizes, ["label", "at"]).withColumn("b", block("own"))
    # Own rows meet own rows of the same or another block (kind 0), and visitors (kind 1).
    pairs = F.transform(upto("own"), lambda o: F.struct(
        F.lit(0).alias("kind"), F.least(o, F.col("b")).alias("left"), F.greatest(o, F.col("b")).alias("right"),
        F.when(o == F.col("b"), 2).when(o > F.col("b"), 0).otherwise(1).alias("side")))
    hosts = F.transform(upto("guests"), lambda g: F.struct(
        F.lit(1).alias("kind"), F.col("b").alias("left"), g.alias("right"), F.lit(0).alias("side")))
    guests = join_small(rows.select("label", "id", "copies", "direction", "shelf", F.lit(None).cast("array<int>").alias("seen"), away), sizes, ["label", "at"]).withColumn("b", block("guests"))
    visits = F.transform(upto("own"), lambda o: F.struct(
        F.lit(1).alias("kind"), o.alias("left"), F.col("b").alias("right"), F.lit(1).alias("side")))
    fields = ["label", "at", "id", "copies", "shelf", "seen", "direction"]
    parts = own.select(*fields, F.explode(F.concat(pairs, F.coalesce(hosts, F.array()))).alias("p")).unionByName(
        guests.select(*fields, F.explode(visits).alias("p")))
    found = parts.select(*fields, "p.*").groupBy("label", "at", "kind", "left", "right").applyInArrow(_verify(similarity), "id long, links long, joined long")
    found = materialize(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("id").alias("u"), F.col("joined").alias("v")))
    classes = classes.join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    classes = materialize(classes.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    member = able.join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component")
    out = named.select("vec_id").join(member, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
