"""The file-to-file jobs, each a composition of readers, operators and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronotext.operators import overlap, topic_model, topics, words, years
from chronotext.operators.arcs import arcs
from chronotext.session import materialize
from chronotext.sources import readers, writers


def title_overlap(titles_path: str, pages: DataFrame, out: str) -> None:
    """Articles (slug, title, one-line text) of the pages whose title is listed."""
    titles = readers.read_lines(pages.sparkSession, titles_path).withColumnRenamed("value", "title")
    matched = overlap.match_titles(pages, titles)
    line = overlap.article_line(F.col("slug"), F.col("title"), F.col("text"))
    writers.write_lines(matched.select(line.alias("value")), out)


def corpus_overlap(spark: SparkSession, selection_path: str, corpus_path: str, out: str) -> None:
    """Lines of a corpus whose first field is that of a selected line; ``out`` must be new."""
    corpus = readers.read_identified_lines(spark, corpus_path)
    selection = readers.read_lines(spark, selection_path)
    matched = overlap.match_lines(corpus, selection, "line_id")
    writers.write_lines(matched.select("value"), out, overwrite=False)


def first_year_corpus(spark: SparkSession, articles_path: str, out: str) -> None:
    """``year<TAB>texts`` from article lines. A year above the part size fills several lines."""
    lines = readers.read_identified_lines(spark, articles_path)
    grouped = years.concat_by_year(years.parse_articles(lines, "line_id"), "line_id")
    writers.write_tsv(grouped.select("year", "text"), out)


def year_window_corpus(spark: SparkSession, articles_path: str, out: str, margin: int = 50) -> None:
    """``year<TAB>words around it`` for every year mention in article lines."""
    articles = years.parse_articles(readers.read_lines(spark, articles_path))
    writers.write_tsv(years.year_windows(articles, [], margin=margin).select("year", "text"), out)


def sparse_corpus(spark: SparkSession, texts_path: str, out: str, by_year: bool = False) -> None:
    """Sparse documents at ``out`` and their vocabulary at ``out-lookup`` from year-text lines."""
    docs = readers.read_year_texts(spark, texts_path)
    vocab = materialize(words.vocabulary(docs))
    writers.write_vocabulary(vocab, out + "-lookup")
    writers.write_sparse_documents(words.sparse_documents(docs, vocab, ["doc_id", "year"]), out, by_year)


def time_sequence(spark: SparkSession, texts_path: str, out: str) -> None:
    """The number of years, then the number of documents of each year in order."""
    counts = materialize(words.documents_per_time(readers.read_year_texts(spark, texts_path)))
    total = counts.agg(F.count(F.lit(1)).alias("n_docs")).select(F.lit(0).alias("line"), F.lit("").alias("year"), "n_docs")
    each = counts.select(F.lit(1).alias("line"), "year", "n_docs")
    ordered = total.unionByName(each).orderBy("line", "year")
    writers.write_lines(ordered.select(F.col("n_docs").cast("string").alias("value")), out)


def topic_terms(spark: SparkSession, lookup_path: str, topics_path: str, out: str, largest: bool = False) -> None:
    """``topic<TAB>year<TAB>terms`` from the files of a dynamic topic model and its vocabulary."""
    cells = readers.read_topic_matrix(spark, topics_path)
    # Ranked first, so only the listed terms are looked up.
    ranked = topics.ranked_terms(cells.withColumnRenamed("term_idx", "term"), largest=largest)
    vocab = readers.read_vocabulary(spark, lookup_path)
    named = ranked.join(vocab, ranked["term"] == vocab["idx"]).select("topic", "year", "place", "token")
    lines = topics.term_lines(named.withColumnRenamed("token", "term"))
    writers.write_lines(lines.orderBy("topic", "year").select("value"), out)


def nearest_years(
    spark: SparkSession,
    texts_path: str,
    list_path: str,
    unseen_directory: str,
    model_path: str,
    reset: bool = False,
    **options,
) -> DataFrame:
    """(doc_id, title, actual_year, train_id, nearest_year, js) for the listed unseen texts.

    Listed titles without a file are reported too: their ``doc_id`` and what follows from the text is NULL.
    """
    docs = materialize(
        years.year_documents(readers.read_table(spark, texts_path, "year", "text")).withColumn(
            "doc_id", F.monotonically_increasing_id()
        )
    )
    model = topic_model.load_or_train(docs.select("doc_id", "text"), model_path, reset, **options)
    listed, missing = readers.read_listed_texts(spark, list_path, unseen_directory)
    unseen = materialize(years.year_documents(listed).withColumn("doc_id", F.monotonically_increasing_id()))
    dated = topic_model.date_documents(model, unseen.drop("title"), docs)
    found = dated.join(unseen.select("doc_id", "title"), "doc_id")
    return found.unionByName(missing.select("title", F.col("year").alias("actual_year")), allowMissingColumns=True)


def year_arcs(spark: SparkSession, pairs_path: str, out: str) -> None:
    """Arc geometry of ``y1-y2,distance`` lines as parquet."""
    arcs(readers.read_year_pairs(spark, pairs_path)).write.mode("overwrite").parquet(out)
