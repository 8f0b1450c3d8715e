"""Mean divergence of documents that lie a given number of years apart."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from chronotext.functions.divergence import js

# The functions below travel with the tasks, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The year gaps reported.
YEAR_GAPS = [0, 1, 2, 5, 10, 25, 50]
PAIRS_PER_GAP = 1000
# A key is cut in this many parts before its rows meet in one task.
KEY_PARTS = 256
# Rows that a scan task waits for before it cuts, and most rows that it keeps between cuts.
CUT_ROWS = 100_000
KEPT_ROWS = 1_000_000


def first_pairs(docs: DataFrame, gaps: list[int] = YEAR_GAPS, first: int = PAIRS_PER_GAP) -> DataFrame:
    """The first ``first`` pairs (i, j), i < j, of each gap in (i, j) order: (d, i, j).

    The result is exact, though not all pairs are formed. Every document that opens a pair opens
    at least one before the next opener, so only the first ``first`` openers of a gap matter. And
    a partner is among the first ``2 * first`` documents of its year: each document of that year
    before i pairs with i, so fewer than ``first`` precede it. Both cuts are made in the scan task and
    then within hashed parts of a year or gap before the rest meets, so one task never gets a whole
    hot year and few ids move.
    """
    ids = docs.select("id", "year")
    last = ids.groupBy("year").agg(F.max("id").alias("last"))
    sides = F.explode(
        F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("shift")) for d in gaps for s in {d, -d}])
    )
    # Every year looks up the last document of the years it pairs with; documents do not move.
    reach = (
        last.select("year", sides.alias("side"))
        .select("year", "side.d", (F.col("year") + F.col("side.shift")).alias("other"))
        .join(last.select(F.col("year").alias("other"), "last"), "other")
        .groupBy("year", "d")
        .agg(F.max("last").alias("last"))
        .groupBy("year")
        .agg(F.collect_list(F.struct("d", "last")).alias("reach"))
    )
    openers = (
        ids.join(F.broadcast(reach), "year")
        .select("id", "year", F.inline("reach"))
        .where(F.col("id") < F.col("last"))
    )
    openers = first_by_id(openers, "d", first).select(F.col("id").alias("i"), "year", "d")
    partners = first_by_id(ids, "year", 2 * first).select(F.col("id").alias("j"), F.col("year").alias("other"))
    both_ways = F.array_distinct(F.array(F.col("year") + F.col("d"), F.col("year") - F.col("d")))
    pairs = (
        partners.join(F.broadcast(openers.select("i", "d", F.explode(both_ways).alias("other"))), "other")
        .where(F.col("i") < F.col("j"))
    )
    in_order = Window.partitionBy("d").orderBy("i", "j")
    return (
        pairs.withColumn("place", F.row_number().over(in_order))
        .where(F.col("place") <= first)
        .select("d", "i", "j")
    )


def _smallest(rows: pa.Table, key: str, first: int) -> pa.Table:
    """The rows of the ``first`` smallest ids of each key."""
    rows = rows.sort_by([(key, "ascending"), ("id", "ascending")])
    if not rows.num_rows:
        return rows
    keys = rows[key].combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lengths = np.diff(np.append(starts, len(keys)))
    return rows.filter(pa.array(np.arange(len(keys)) - np.repeat(starts, lengths) < first))


def _cut_in_task(key: str, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, size = None, [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size < CUT_ROWS:
                continue
            table = pa.Table.from_batches(waiting)
            kept = _smallest(table if kept is None else pa.concat_tables([kept, table]), key, first)
            waiting, size = [], 0
            if kept.num_rows > KEPT_ROWS:  # many keys: hand on what there is, and begin anew
                yield from kept.to_batches()
                kept = None
        if waiting:
            table = pa.Table.from_batches(waiting)
            kept = _smallest(table if kept is None else pa.concat_tables([kept, table]), key, first)
        if kept is not None:
            yield from kept.to_batches()

    return run


def first_by_id(df: DataFrame, key: str, first: int) -> DataFrame:
    """The rows of the ``first`` smallest ids of each key; rows without a key or an id are left out.

    Each scan task keeps its own first rows of a key, so ids beyond them cross no exchange; the rest
    is cut within hashed parts of the key and then within the key.
    """
    df = df.where(F.col(key).isNotNull() & F.col("id").isNotNull())
    df = df.mapInArrow(_cut_in_task(key, first), df.schema)
    part = F.pmod(F.xxhash64("id"), F.lit(KEY_PARTS)).alias("_part")
    for keys in ([key, part], [key]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        df = df.withColumn("_place", place).where(F.col("_place") <= first).drop("_place")
    return df


def mean_by_year_gap(docs: DataFrame, gaps: list[int] = YEAR_GAPS, first: int = PAIRS_PER_GAP) -> DataFrame:
    """(d, pairs, mean_js) over the first pairs of each gap; one row per gap, also without pairs.

    ``docs`` has (id, year, theta). There are at most ``first`` pairs per gap, so they are
    broadcast and only the thetas they name are kept from the scan.
    """
    pairs = first_pairs(docs, gaps, first)
    thetas = docs.select("id", "theta")
    left = thetas.select(F.col("id").alias("i"), F.col("theta").alias("p"))
    right = thetas.select(F.col("id").alias("j"), F.col("theta").alias("q"))
    means = (
        right.join(F.broadcast(left.join(F.broadcast(pairs), "i")), "j")
        .groupBy("d")
        .agg(F.count(F.lit(1)).alias("pairs"), F.avg(js("p", "q")).alias("mean_js"))
    )
    wanted = docs.sparkSession.createDataFrame([(d,) for d in gaps], "d int")
    return wanted.join(means, "d", "left").select(
        "d", F.coalesce("pairs", F.lit(0)).alias("pairs"), "mean_js"
    )
