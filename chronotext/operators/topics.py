"""Tables of topics: terms per topic and year, packed counts, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronotext.functions.text import clip

# The first year of a topic-by-time table and its number of time slots.
FIRST_YEAR = 1800
TIME_SLOTS = 100
TERMS_PER_TOPIC = 10
LISTING_CHARS = 500


def slot_year(time_idx: Column | str) -> Column:
    time_idx = F.col(time_idx) if isinstance(time_idx, str) else time_idx
    return time_idx + FIRST_YEAR


def ranked_terms(cells: DataFrame, k: int = TERMS_PER_TOPIC, largest: bool = False) -> DataFrame:
    """(topic, year, place, term, logp): ``k`` terms per topic and time slot.

    The lowest log-probabilities by default, the largest on request; equal ones by term. Each task
    keeps its own first ``k`` before the shuffle.
    """
    first = F.desc("logp") if largest else F.asc("logp")
    order = Window.partitionBy("topic", "time_idx").orderBy(first, "term")
    return (
        cells.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
        .select("topic", slot_year("time_idx").alias("year"), "place", "term", "logp")
    )


def term_lines(ranked: DataFrame) -> DataFrame:
    """``topic<TAB>year<TAB>terms`` from ranked terms; a line holds the few terms of one slot."""
    words = F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda t: t["term"])
    return (
        ranked.groupBy("topic", "year")
        .agg(F.array_join(words, " ").alias("terms"))
        .select("topic", "year", F.concat_ws("\t", "topic", "year", "terms").alias("value"))
    )


def unpack_counts(packed: DataFrame, mask: int, bits: int) -> DataFrame:
    """(type, topic, n) from (type, values): low bits are the topic, high bits the count.

    A type's values end before the first one that is not positive.
    """
    stop = F.array_position(F.transform("values", lambda v: v <= 0), True)
    kept = F.when(stop > 0, F.slice("values", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("values"))
    return packed.select("type", F.explode(kept).alias("value")).select(
        "type",
        F.col("value").bitwiseAND(mask).alias("topic"),
        F.shiftright("value", bits).alias("n"),
    )


def topic_listing(counts: DataFrame, chars: int = LISTING_CHARS) -> DataFrame:
    """(topic, types, total, line) with ``type:n type:n ...`` in type order, cut at ``chars``.

    An entry with its space takes at least four characters, so the first ``chars / 4 + 1``
    types of a topic fill the line and no topic is collected whole.
    """
    totals = counts.groupBy("topic").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("total"))
    enough = chars // 4 + 1
    order = Window.partitionBy("topic").orderBy("type")
    entry = F.concat_ws(":", F.col("type").cast("string"), F.col("n").cast("string"))
    lines = (
        counts.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= enough)
        .select("topic", F.struct("place", entry.alias("entry")).alias("cell"))
        .groupBy("topic")
        .agg(F.sort_array(F.collect_list("cell")).alias("cells"))
        .select("topic", clip(F.array_join("cells.entry", " "), chars).alias("line"))
    )
    return totals.join(lines, "topic")
