"""Word counts, the ranked vocabulary and sparse documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronotext.functions.text import VOCABULARY_STOPWORDS, letter_tokens, lookup_line
from chronotext.operators import blocks
from chronotext.session import materialize

# Words ranked above this can be hot; each word below it holds less than 1/HEAD of all tokens,
# because that many others are at least as frequent.
HEAD = 100_000


def count_tokens(docs: DataFrame, tokens: Column, keep: Column | None = None) -> DataFrame:
    """(token, n) over all documents; counts are combined before the shuffle."""
    exploded = docs.select(F.explode(tokens).alias("token"))
    if keep is not None:
        exploded = exploded.where(keep)
    return exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def not_stopword(stopwords: list[str]) -> Column:
    return ~F.col("token").isin(stopwords)


def frequency_rank(counts: DataFrame) -> DataFrame:
    """Number (token, n) rows from 0, most frequent first, equal counts by token, at every size."""
    return number_in_order(counts, F.desc("n"), "token").select("idx", "token", "n")


def number_in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """Add ``idx``, the place from 0 in the given order, which tells all rows apart.

    Runs a job: the rows are dealt out by ranges of the order, which unique rows split evenly, and
    written with their place in the range. The ranges start where those before them end; that
    table has one row per shuffle partition, so it is summed up in one task and broadcast.
    """
    row = F.monotonically_increasing_id()
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "*", F.shiftright(row, 33).alias("_range"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")
        )
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    numbered = placed.join(F.broadcast(starts), "_range")
    return numbered.withColumn("idx", F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(idx, token, n) of the letter tokens without stop words."""
    counts = count_tokens(docs, letter_tokens(text), not_stopword(VOCABULARY_STOPWORDS))
    return frequency_rank(counts)


def vocabulary_lines(vocab: DataFrame) -> DataFrame:
    return vocab.select(lookup_line("idx", "token").alias("value"))


def sparse_documents(
    docs: DataFrame,
    vocab: DataFrame,
    keys: list[str],
    text: str = "text",
    head: int = HEAD,
    **limits,
) -> DataFrame:
    """One row per document: its keys, number of distinct terms, and (idx, n) sorted by idx.

    ``keys`` starts with a unique document id. ``vocab`` is materialised. Documents without any
    known token stay, with no terms. Words are counted per document and looked up once for each block
    of documents, so neither ``head`` nor other ``limits`` of a lookup for each document matter any more.
    """
    counted = blocks.word_blocks(docs, letter_tokens(text), keys[0], keys[1:])
    found = counted.words.select("block", "at", "token").join(vocab.select("token", "idx"), "token").select("block", "at", "idx")
    kinds = ", ".join(f"`{key}` {docs.schema[key].dataType.simpleString()}" for key in keys)
    terms = blocks.in_blocks(counted.documents, found, blocks.sparse(keys[0], keys[1:]), f"{kinds}, terms array<struct<idx:long,n:long>>")
    return terms.select(*keys, F.size("terms").alias("n_terms"), "terms")


def documents_per_time(docs: DataFrame, time: str = "year") -> DataFrame:
    """(time, n_docs) in time order."""
    return docs.groupBy(time).agg(F.count(F.lit(1)).alias("n_docs")).orderBy(time)


def score_topics(
    docs: DataFrame,
    weights: DataFrame,
    tokens: Column,
    heaviest: Column,
    doc_id: str = "doc_id",
    k: int = 5,
    **limits,
) -> DataFrame:
    """The ``k`` topics of each document with the largest sum of token weights.

    ``weights`` is materialised: token, an array of (topic, weight). Each occurrence of a token counts;
    they are counted per document, and the weights of a token are looked up once for each block of documents,
    so it does not matter which are ``heaviest``, nor other ``limits`` of a lookup for each document.
    """
    counted = blocks.word_blocks(docs, tokens, doc_id)
    found = counted.words.select("block", "at", "token").join(weights.select("token", "topics"), "token").select("block", "at", "topics")
    topic = weights.schema["topics"].dataType.elementType["topic"].dataType.simpleString()
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, topic {topic}, score double"
    scores = blocks.in_blocks(counted.documents, found, blocks.scored(doc_id), schema)
    order = Window.partitionBy(doc_id).orderBy(F.desc("score"), "topic")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
