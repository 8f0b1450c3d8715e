"""Joins against a side with unique keys, safe for hot keys on the other side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronotext.session import BROADCAST_BYTES, fits_broadcast, materialize


def semi_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    row_id: str,
    salts: int | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``, each once and unchanged.

    The distinct keys are written once and measured. Small ones are broadcast and ``left`` is
    not shuffled. Otherwise the keys of ``left`` are counted, and those that hold more than a
    task's fair share of its rows, no more than there are tasks, are spread over as many
    ``salts`` as they hold such shares by their unique ``row_id``. All other rows meet their key unsalted.
    """
    keys = materialize(right.select(on).where(F.col(on).isNotNull()).distinct())
    if fits_broadcast(keys, limit):
        return left.join(F.broadcast(keys), on, "left_semi")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_rows")))
    share = F.lit(max(1, -(-(counts.agg(F.sum("_rows")).first()[0] or 0) // tasks)))
    wanted = F.lit(salts) if salts else F.ceil(F.col("_rows") / share).cast("int")
    # Each has more than 1/tasks of the rows, so there are fewer than tasks of them.
    hot = F.broadcast(counts.where(F.col("_rows") > share).select(on, wanted.alias("_salts")))
    times = F.coalesce("_salts", F.lit(1))
    salted = keys.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), times - 1))).drop("_salts")
    spread = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(row_id), times).cast("int")).drop("_salts")
    return spread.join(salted, [on, "_salt"], "left_semi").select(*left.columns)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str,
    frequent: Column,
    row_id: str,
    salts: int = 256,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Inner join of ``facts`` with a materialised ``lookup`` that has one row per key.

    A lookup of checked size is broadcast whole. A larger one is cut by ``frequent``, a condition
    that only a fixed number of keys can meet, the only ones that can be hot. Their rows are
    broadcast if they fit and otherwise repeated over ``salts``, where ``row_id`` spreads the
    facts. The other facts are joined by a shuffle.
    """
    if fits_broadcast(lookup, limit):
        return facts.join(F.broadcast(lookup), on)
    head = lookup.where(frequent)
    keys = F.broadcast(head.select(on))
    if fits_broadcast(head, limit):
        hot = facts.join(F.broadcast(head), on)
    else:
        salt = F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")
        copies = head.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        spread = facts.join(keys, on, "left_semi").withColumn("_salt", salt)
        hot = spread.join(copies, [on, "_salt"]).drop("_salt")
    rare = facts.join(keys, on, "left_anti").join(lookup.where(~frequent), on)
    return hot.unionByName(rare)
