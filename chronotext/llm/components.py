"""Connected components: within a task by numpy, over all tasks by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from chronotext.session import materialize


def local_components(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each id the smallest id that the links (a, b), places in ``ids``, lead to."""
    labels = ids.copy()
    while len(a):
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        if (before == labels).all():
            break
    return labels


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v) that has a smaller one in its component.

    Large and small stars take turns: each node passes its larger neighbours, then its smaller ones,
    to the smallest of them, until nothing changes. Each round is written, so a lost
    executor costs one round at most, and moves one row per edge; nothing is gathered.
    """
    pairs = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = materialize(pairs.distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
