"""Packing: length buckets of least padding by dynamic programming, token-budget batches inside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronotext.llm.common import slices, texts
from chronotext.llm.hashing import word_places
from chronotext.session import materialize

BUCKETS = 16
TOKEN_BUDGET = 16384


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The bucket lengths that minimise sum(count * (bucket - length)), each an occurring length.

    ``lengths`` ascend. best[j], over the first j lengths with b buckets, is the least over i of
    best'[i] + the padding of lengths i ... j - 1 up to the last of them. The best i never falls as
    j grows, so each layer is solved by halving ranges: b * n * log n steps. Of equal splits the
    smallest i is taken.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    tokens = np.concatenate([[0], np.cumsum(lengths.astype(np.int64) * counts, dtype=np.int64)])

    def padding(i, j):
        return (rows[j] - rows[i]) * lengths[j - 1] - (tokens[j] - tokens[i])

    best = np.array([0] + [padding(0, j) for j in range(1, n + 1)], dtype=np.int64)
    cuts = []
    for b in range(2, min(buckets, n) + 1):
        layer, cut = np.full(n + 1, np.iinfo(np.int64).max), np.zeros(n + 1, dtype=np.int64)
        ranges = [(b, n, b - 1, n - 1)]
        while ranges:
            low, high, first, last = ranges.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + padding(i, j)
            at = int(cost.argmin())
            layer[j], cut[j] = cost[at], i[at]
            ranges += [(low, j - 1, first, int(i[at])), (j + 1, high, int(i[at]), last)]
        best = layer
        cuts.append(cut)
    bounds, j = [int(lengths[-1])], n
    for cut in reversed(cuts):
        j = int(cut[j])
        bounds.append(int(lengths[j - 1]))
    return bounds[::-1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.zeros(0, np.int64)]
        for _, _, data, offsets in slices(batch.column(1)):
            counts.append(np.diff(word_places(data, offsets)[2]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts))], ["doc_id", "n_tokens"])


def count_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): the words of whole texts, between ASCII white space."""
    return texts(docs).mapInArrow(_count, "doc_id long, n_tokens long")


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, batch, slot) for every row of ``docs`` with an id.

    ``bucket`` is the padded length. Buckets are those of least padding over all documents: the
    histogram of lengths is counted by Spark and has one row per distinct length, fewer than the square
    root of twice the number of tokens; only it goes to the driver. Within a bucket documents are
    ordered by length and id, and each budget // bucket of them (one at least) form a batch, so a
    longer document than the budget is a batch of its own; ``slot`` counts within the batch.

    Places in a bucket come from one range sort over all documents and the counts of each range, so
    a bucket that holds a third of the documents is spread over many tasks. Null and empty texts have
    0 tokens and go to the smallest bucket; repeated rows are packed as often as they occur; an
    empty table gives no rows. Other columns are not read.
    """
    counted = materialize(count_tokens(docs))
    histogram = counted.groupBy("n_tokens").count().orderBy("n_tokens").toPandas()
    bounds = bucket_bounds(histogram["n_tokens"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), buckets)
    bounds = bounds or [0]
    bucket = F.array_min(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b >= F.col("n_tokens")))
    ranged = counted.withColumn("bucket", bucket).repartitionByRange("n_tokens", "doc_id").sortWithinPartitions("n_tokens", "doc_id")
    placed = materialize(ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()))
    # One row per range and bucket: no more than partitions + buckets, as ranges follow the lengths.
    parts = placed.groupBy("bucket", "range").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low"))
    before = Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("bucket", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    place = F.col("place") + F.col("shift")
    each = F.greatest(F.lit(1).cast("long"), F.expr(f"{int(budget)} div greatest(bucket, 1)"))
    ranked = placed.join(F.broadcast(starts), ["bucket", "range"]).withColumn("rank", place).withColumn("each", each)
    return ranked.select("doc_id", "n_tokens", "bucket", F.expr("rank div each").alias("batch"), F.expr("rank % each").alias("slot"))
