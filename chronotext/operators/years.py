"""Years mentioned in texts, the words around them, and documents per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronotext.functions.text import YEAR, explode_first_year, fields
from chronotext.session import fits_broadcast, materialize

PART_CHARS = 64 * 1024 * 1024


def parse_articles(lines: DataFrame, *keep: str) -> DataFrame:
    """(slug, title, text) of the lines with exactly three fields; other lines go."""
    parts = lines.select(*keep, fields("value").alias("_f")).where(F.size("_f") == 3)
    names = ("slug", "title", "text")
    return parts.select(*keep, *(F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)))


def year_documents(docs: DataFrame, low: int = 1700, high: int = 1911) -> DataFrame:
    """Documents with a year in [low, high] as a number; ``xxxx`` and other words go."""
    written = F.col("year").cast("string")
    number = written.try_cast("int")
    dated = docs.where((written != "xxxx") & number.between(low, high))
    return dated.withColumn("year", number)


def concat_by_year(docs: DataFrame, doc_id: str = "doc_id", part_chars: int = PART_CHARS) -> DataFrame:
    """(year, part, n_docs, text): the texts of each first year in id order, joined by spaces.

    One rule at every size: a document is in part ``c div part_chars``, where c is the length of
    the documents of its year before it, each with one separator. So no task holds a hot year.
    Only (year, id, length) is ordered; the texts travel once to their part, or twice where the
    table of parts is too large to broadcast. Runs jobs while the plan is built.
    """
    dated = docs.select(doc_id, "text", explode_first_year("text").alias("year")).where("year IS NOT NULL")
    sizes = dated.select("year", doc_id, (F.length("text").cast("long") + 1).alias("_size"))
    parts = materialize(
        sum_before(sizes, "year", doc_id, "_size").select(
            doc_id, "year", F.floor(F.col("_before") / part_chars).cast("int").alias("part")
        )
    )
    if fits_broadcast(parts):
        placed = docs.select(doc_id, "text").join(F.broadcast(parts), doc_id)
    else:
        placed = docs.select(doc_id, "text").join(parts, doc_id)
    return placed.groupBy("year", "part").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(doc_id, "text"))), lambda d: d["text"]), " "
        ).alias("text"),
    )


def sum_before(df: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Add ``_before``, the sum of ``size`` over the rows of a key that come earlier.

    The rows are dealt out by ranges of (key, order), so a hot key spans many ranges. Sums run
    inside a range and start with the sum of the ranges before it. Ranges of one key are as many
    as shuffle partitions at most.
    """
    ranged = materialize(
        df.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(key, "_range").agg(F.sum(size).alias("_sum")).select(
        key, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return (
        running.join(starts, [key, "_range"])
        .withColumn("_before", F.col("_start") + F.col("_inside"))
        .drop("_range", "_start", "_inside")
    )


def year_windows(docs: DataFrame, keys: list[str], text: str = "text", margin: int = 50) -> DataFrame:
    """One row per year mention: keys, its position, the year, and the words around it.

    ``margin`` words before and ``margin - 1`` after the first token that starts at or after the
    year, which itself is left out; the last ``2 * margin`` words when no such token follows.
    Everything happens within the row, and only mentions are exploded, never tokens.
    """
    tokens = F.regexp_extract_all(F.col(text), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))

    def mentions(token: Column, place: Column) -> Column:
        """(year, place of the first token at or after it) for each year in one token."""
        opens = token.rlike(r"\A" + YEAR)
        found = F.transform(
            F.regexp_extract_all(token, F.lit(YEAR), F.lit(0)),
            lambda year, nth: F.struct(
                year.alias("year"),
                (place + F.when((nth == 0) & opens, 0).otherwise(1)).alias("at"),
            ),
        )
        none = F.array().cast("array<struct<year:string,at:int>>")
        return F.when(token.rlike("[0-9]{4}"), found).otherwise(none)

    def window(mention: Column) -> Column:
        at, total = mention["at"], F.size("tokens")
        before = F.slice("tokens", F.greatest(at - margin, F.lit(0)) + 1, F.least(at, F.lit(margin)))
        after = F.slice("tokens", at + 2, F.lit(margin - 1))
        last = F.slice("tokens", F.greatest(total - 2 * margin, F.lit(0)) + 1, F.lit(2 * margin))
        words = F.when(at < total, F.concat(before, after)).otherwise(last)
        return F.struct(mention["year"].alias("year"), F.array_join(words, " ").alias("text"))

    return (
        docs.where(F.col(text).rlike("[0-9]{4}"))
        .select(*keys, tokens.alias("tokens"))
        .withColumn("mentions", F.flatten(F.transform("tokens", mentions)))
        # The expression itself is exploded: on a column, Spark would infer a filter for its size
        # and compute the windows once more for it.
        .select(*keys, F.posexplode(F.transform("mentions", window)).alias("position", "window"))
        .select(*keys, "position", "window.year", "window.text")
    )
