"""The corpus pipeline: toxicity, near-duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronotext.llm import minhash, packing, secrets, substrings, toxicity
from chronotext.llm.common import join_small, table
from chronotext.session import materialize


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` as the changed text has it."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity model does not reject, as they are; it is learned from the labels of ``folder``."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, folder, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates.

    Of rows that repeat an id with the same text one stays. An id that is repeated with different texts
    goes as a whole if one of them is a near-duplicate of a document with a smaller id. Rows without an id
    are compared with nothing and stay.
    """
    copies = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    repeated = materialize(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    left = join_small(docs, materialize(copies), "doc_id", "left_anti").select(*docs.columns)
    once = join_small(left, repeated, "doc_id", "left_anti").select(*docs.columns)
    again = join_small(left, repeated, "doc_id", "left_semi").select(*docs.columns)
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the words of passages that occur earlier."""
    return measured(substrings.remove_repeated(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return measured(secrets.redact_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, batch, slot) of every document left that has an id.

    Rows without one pass the stages before by their texts and end here, as no batch could name them.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("secret scans", redact_secrets),
    ("packing", pack),
]
#: The toxicity model is learned from labels, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before wrote."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
