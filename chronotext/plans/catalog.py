"""The registered queries: each operator over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronotext.functions import text as tx
from chronotext.functions.divergence import js, kl, normalize, pairwise_mean
from chronotext.operators import blocks, gaps, nearest, overlap, topic_model, topics, words, years
from chronotext.operators.arcs import arcs, parse_year_pairs
from chronotext.session import materialize, shared_folder, spread
from chronotext.sources import archive, readers, writers

Query = Callable[[SparkSession, str], DataFrame]

LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Small enough that years of the given tables fill several parts.
YEAR_PART_CHARS = 8192
ARCHIVE_BLOCK = 64
# Few enough iterations that their SQL can be written out.
MODEL_TOPICS = 10
MODEL_ITERATIONS = 3
PACK_BITS = 5
PACK_MASK = 31


# --- tables and what Spark derives from them ---------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", *columns), "doc_id")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return readers.html_pages(table(spark, folder, "pages"))


def derived_year() -> Column:
    return F.lit(1650) + F.col("doc_id") * 7 % 300


def head_line(text: Column | str = "text") -> Column:
    """The first line of a document, which serves as its title."""
    return F.substring_index(text, "\n", 1)


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a year in the middle of the text."""
    half = F.floor(F.length("text") / 2).cast("int")
    middle = F.concat(F.lit(" "), derived_year().cast("string"), F.lit(" "))
    text = F.concat(F.substring("text", F.lit(1), half), middle, F.expr("substr(text, CAST(floor(length(text) / 2) AS INT) + 1)"))
    return documents(spark, folder, "lang").withColumn("text", text)


def article_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, value): article lines, some with a missing, additional or trailing field."""
    text = tx.flatten_whitespace("text")
    ending = (
        F.when(F.col("lang") == "fr", "")
        .when(F.col("lang") == "de", F.concat(text, F.lit("\textra")))
        .when(F.col("lang") == "es", F.concat(text, F.lit("\t\t")))
        .otherwise(text)
    )
    title = F.regexp_replace(head_line(), "\t", " ")
    docs = documents(spark, folder, "lang")
    return docs.select("doc_id", overlap.article_line(tx.slug(title), title, ending).alias("value"))


def year_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, year, text) with a year in words, also ``xxxx`` and one that is no number."""
    year = (
        F.when(F.col("lang") == "es", "xxxx")
        .when(F.col("lang") == "de", F.concat(F.lit("c."), derived_year().cast("string")))
        .otherwise(derived_year().cast("string"))
    )
    return documents(spark, folder, "lang").select("doc_id", year.alias("year"), "text")


def vector_thetas(spark: SparkSession, folder: str) -> DataFrame:
    """(id, year, theta) from the absolute values of the vectors."""
    size = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.lit(1700) + F.col("vec_id") % 212).cast("int").alias("year"),
        normalize(size).alias("theta"),
    )


def initial_thetas(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, year, theta): shares of the first letters a ... z among the words of each text."""
    counts = blocks.initial_counts(df, id_column, text).groupBy("id").agg(*[F.sum(F.col("counts")[i]).alias(c) for i, c in enumerate(LETTERS)])
    counts = counts.withColumn("total", sum((F.col(c) for c in LETTERS[1:]), F.col(LETTERS[0])))
    year = (F.lit(1700) + F.col("id") % 212).cast("int")
    return counts.select("id", year.alias("year"), F.array(*[F.col(c) / F.col("total") for c in LETTERS]).alias("theta"))


def topic_cells(spark: SparkSession, folder: str) -> DataFrame:
    """(topic, time_idx, term, logp): share of each word in a language and slot."""
    docs = documents(spark, folder, "lang")
    counts = (
        docs.select("lang", (F.col("doc_id") % 10).cast("int").alias("time_idx"), F.explode(tx.letter_tokens("text")).alias("term"))
        .groupBy("lang", "time_idx", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("lang", "time_idx").agg(F.sum("n").alias("total"))
    return counts.join(totals, ["lang", "time_idx"]).select(
        F.col("lang").alias("topic"), "time_idx", "term", F.ln(F.col("n") / F.col("total")).alias("logp")
    )


def source_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(token, topic, n): word counts per source, whose number is the topic."""
    topic = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    return (
        documents(spark, folder, "source")
        .select(topic.alias("topic"), F.explode(tx.letter_tokens("text")).alias("token"))
        .groupBy("token", "topic")
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
    )


def packed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(type, values): counts per source packed with the source number, and 0 for each 7th count."""
    packed = F.when(F.col("n") % 7 == 0, 0).otherwise(F.shiftleft("n", PACK_BITS).bitwiseOR(F.col("topic")))
    by_count = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "topic", packed.alias("v"))))
    return source_counts(spark, folder).groupBy(F.col("token").alias("type")).agg(by_count["v"].alias("values"))


def year_pair_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(value): ``y1-y2,distance`` between the mean thetas of two years.

    Years are numbers from 1700 to 1911, so there are at most 212 of them.
    """
    cells = vector_thetas(spark, folder).select("year", F.posexplode("theta"))
    means = cells.groupBy("year", "pos").agg(F.avg("col").alias("m"))
    years_ = means.groupBy("year").agg(F.sort_array(F.collect_list(F.struct("pos", "m")))["m"].alias("theta"))
    years_ = materialize(years_)
    later = F.explode(F.sequence(F.col("year") + 1, F.greatest(F.col("year") + 1, F.lit(1911))))
    first = years_.select(F.col("year").alias("y1"), F.col("theta").alias("p"), later.alias("y2"))
    second = years_.select(F.col("year").alias("y2"), F.col("theta").alias("q"))
    return first.join(second, "y2").select(
        F.format_string("%d-%d,%.12f", "y1", "y2", js("p", "q")).alias("value")
    )


# --- queries -----------------------------------------------------------------------------------


def word_count(spark, folder):
    return words.count_tokens(documents(spark, folder), tx.word_tokens("text"))


def dtm_token_counts(spark, folder):
    keep = words.not_stopword(tx.VOCABULARY_STOPWORDS)
    return words.count_tokens(documents(spark, folder), tx.letter_tokens("text"), keep)


def lda_token_counts(spark, folder):
    keep = words.not_stopword(tx.TOPIC_STOPWORDS) & ~tx.is_number("token")
    return words.count_tokens(documents(spark, folder), tx.word_tokens("text"), keep)


def strict_tsv_parse(spark, folder):
    return years.parse_articles(article_lines(spark, folder), "doc_id")


def year_text_lines(spark, folder):
    """Lines with at least two fields as (doc_id, year, text)."""
    return readers.parse_year_texts(article_lines(spark, folder))


def year_range_docs(spark, folder):
    return years.year_documents(year_texts(spark, folder))


def leading_years(spark, folder):
    written = F.concat(F.col("year"), F.lit("-01-02"))
    return year_texts(spark, folder).select("doc_id", tx.leading_year(written).alias("year"))


def dtm_vocabulary(spark, folder):
    return words.vocabulary(documents(spark, folder))


def dtm_lookup(spark, folder):
    return readers.parse_vocabulary(words.vocabulary_lines(words.vocabulary(documents(spark, folder))))


def dtm_sparse_docs(spark, folder):
    docs = documents(spark, folder).withColumn("year", derived_year())
    vocab = materialize(words.vocabulary(docs))
    sparse = words.sparse_documents(docs, vocab, ["doc_id", "year"])
    line = F.concat(F.col("year").cast("string"), F.lit("\t"), tx.sparse_line("terms"))
    return sparse.select("doc_id", "year", "n_terms", line.alias("value"))


def vocabulary_file(spark, folder):
    """The vocabulary, written as a lookup file and read from it."""
    path = f"{shared_folder(spark)}/lookup-{uuid.uuid4().hex}"
    writers.write_vocabulary(words.vocabulary(documents(spark, folder)), path)
    return readers.read_vocabulary(spark, path)


def article_file(spark, folder):
    """Article lines, written as text and read and parsed from it."""
    path = f"{shared_folder(spark)}/articles-{uuid.uuid4().hex}"
    writers.write_lines(article_lines(spark, folder).select("value"), path, overwrite=False)
    lines = readers.read_identified_lines(spark, path)
    return years.parse_articles(lines, "line_id").select("slug", "title", "text")


def year_text_file(spark, folder):
    """Years and texts of the documents, written as a tab-separated file and read as a table by the year's first digits."""
    path = f"{shared_folder(spark)}/years-{uuid.uuid4().hex}"
    texts = year_texts(spark, folder).select(F.concat("year", F.lit("-01")).alias("year"), tx.flatten_whitespace("text").alias("text"))
    writers.write_tsv(texts, path)
    return readers.read_table(spark, path, "year", "text").select(tx.leading_year("year").alias("year"), F.sha2("text", 256).alias("text_sha256"))


def trainer_documents(spark, folder):
    """The lines that a topic trainer reads: one sparse document each, without its year, in order of time."""
    docs = documents(spark, folder).withColumn("year", derived_year())
    vocab = materialize(words.vocabulary(docs))
    sparse = words.sparse_documents(docs, vocab, ["doc_id", "year"])
    path = f"{shared_folder(spark)}/trainer-{uuid.uuid4().hex}"
    writers.write_trainer_documents(sparse, path)
    return readers.read_ordered_lines(spark, path)


def dtm_docs_per_year(spark, folder):
    dated = table(spark, folder, "documents").select(derived_year().alias("year"))
    return words.documents_per_time(dated)


def title_overlap(spark, folder):
    listed = F.concat(F.lit("  "), head_line(), F.lit("!?"))
    titles = table(spark, folder, "documents").select(listed.alias("title"))
    # Markup is taken out of the pages that match only.
    marked = table(spark, folder, "pages").select("page_id", tx.html_title("html").alias("title"), "html")
    return overlap.match_titles(marked, titles, body="html", content=tx.html_content("html"))


def page_articles(spark, folder):
    line = overlap.article_line(tx.slug("title"), F.col("title"), tx.flatten_whitespace("content"))
    return pages(spark, folder).select("page_id", line.alias("value"))


def corpus_overlap(spark, folder):
    line = overlap.article_line(tx.slug("title"), F.col("title"), F.lit("text"))
    selection = pages(spark, folder).select(line.alias("value"))
    return overlap.match_lines(article_lines(spark, folder), selection, "doc_id")


def page_by_id(spark, folder):
    return readers.html_pages(overlap.page_by_id(table(spark, folder, "pages"), 7))


def written_archive(spark: SparkSession, folder: str) -> str:
    """An archive of all pages, of files small enough that the given tables fill several."""
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    archive.write_archive(table(spark, folder, "pages"), path, ARCHIVE_BLOCK)
    return path


def page_archive(spark, folder):
    """Numbers, titles and texts of all pages, through an archive."""
    stored = archive.read_archive(spark, written_archive(spark, folder))
    return stored.select("number", "page_id", tx.html_title("html").alias("title"), tx.html_content("html").alias("content"))


def page_by_number(spark, folder):
    return readers.html_pages(archive.page_at(spark, written_archive(spark, folder), 7))


def archived_page(spark, folder):
    return readers.html_pages(archive.archived_page(spark, written_archive(spark, folder), 7))


def first_year_groups(spark, folder):
    return years.concat_by_year(articles(spark, folder), part_chars=YEAR_PART_CHARS)


def year_windows(spark, folder):
    return years.year_windows(articles(spark, folder), ["doc_id"])


def neighbour_pairs(spark, folder):
    """Each vector with the one numbered next."""
    thetas = vector_thetas(spark, folder)
    left = thetas.select("id", F.col("theta").alias("p"))
    right = thetas.select((F.col("id") - 1).alias("id"), F.col("theta").alias("q"))
    return left.join(right, "id")


def kl_pairs(spark, folder):
    return neighbour_pairs(spark, folder).select(
        "id", F.round(kl("p", "q"), 6).alias("kl"), F.round(kl("p", pairwise_mean("p", "q")), 6).alias("kl_mean")
    )


def js_pairs(spark, folder):
    return neighbour_pairs(spark, folder).select("id", F.round(js("p", "q"), 6).alias("js"))


def js_nearest_year(spark, folder):
    training = initial_thetas(documents(spark, folder), "doc_id", "text")
    unseen = initial_thetas(spread(pages(spark, folder), "page_id"), "page_id", "content")
    found = nearest.nearest_document(unseen.select("id", "theta"), training)
    return found.select("id", F.round("js", 6).alias("js"), "train_id", "year")


def js_mean_by_year_gap(spark, folder):
    means = gaps.mean_by_year_gap(vector_thetas(spark, folder))
    return means.select("d", "pairs", F.round("mean_js", 6).alias("mean_js"))


def topic_lowest_terms(spark, folder):
    ranked = topics.ranked_terms(topic_cells(spark, folder))
    return ranked.withColumn("logp", F.round("logp", 6))


def topic_top_terms(spark, folder):
    ranked = topics.ranked_terms(topic_cells(spark, folder), largest=True)
    return ranked.withColumn("logp", F.round("logp", 6))


def topic_term_lines(spark, folder):
    return topics.term_lines(topics.ranked_terms(topic_cells(spark, folder)))


def topic_matrix_cells(spark, folder):
    """The vectors of a label, one after the other, as the lines of one topic file."""
    lines = table(spark, folder, "embeddings").select(
        F.col("label").alias("file"), F.col("vec_id").alias("split"), F.posexplode("embedding").alias("place", "logp")
    )
    numbered = readers.number_lines(materialize(lines))
    return numbered.select(F.col("file").alias("topic"), *readers.matrix_cell("line"), "logp")


def topic_type_counts(spark, folder):
    return topics.unpack_counts(packed_counts(spark, folder), PACK_MASK, PACK_BITS)


def topic_listing(spark, folder):
    return topics.topic_listing(topic_type_counts(spark, folder))


def doc_topic_scores(spark, folder):
    weight = F.struct("topic", F.col("n").cast("double").alias("weight"))
    weights = materialize(
        source_counts(spark, folder)
        .groupBy("token")
        .agg(F.collect_list(weight).alias("topics"), F.sum("n").alias("n"))
    )
    total = weights.agg(F.sum("n").alias("n")).first()["n"] or 0
    # No more than HEAD tokens can hold 1/HEAD of all occurrences each.
    hot = F.col("n") * words.HEAD >= total
    return words.score_topics(documents(spark, folder), weights, tx.letter_tokens("text"), hot)


def year_pair_arcs(spark, folder):
    shapes = arcs(parse_year_pairs(materialize(year_pair_lines(spark, folder))))
    return shapes.select(
        "year1",
        "year2",
        "cx",
        "r",
        F.round("stroke_width", 6).alias("stroke_width"),
        F.round("opacity", 6).alias("opacity"),
    )


def lda_topics(spark, folder):
    model = topic_model.train(documents(spark, folder), k=MODEL_TOPICS, iterations=MODEL_ITERATIONS)
    return model.listing().withColumn("weight", F.round("weight", 6))


def lda_nearest_year(spark, folder):
    training = years.year_documents(documents(spark, folder).withColumn("year", derived_year().cast("string")))
    unseen = pages(spark, folder).select(
        F.col("page_id").alias("doc_id"),
        (F.lit(1700) + F.col("page_id") % 212).alias("year"),
        F.col("content").alias("text"),
    )
    model = topic_model.train(training, k=MODEL_TOPICS, iterations=MODEL_ITERATIONS)
    dated = topic_model.date_documents(model, spread(unseen, "doc_id"), training, passes=MODEL_ITERATIONS, counted=model.counted)
    return dated.withColumn("js", F.round("js", 6))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        word_count, dtm_token_counts, lda_token_counts, strict_tsv_parse, year_text_lines,
        year_range_docs, leading_years, dtm_vocabulary, dtm_lookup, dtm_sparse_docs,
        vocabulary_file, article_file, year_text_file, trainer_documents, dtm_docs_per_year, title_overlap, page_articles, corpus_overlap, page_by_id, page_archive, page_by_number, archived_page,
        first_year_groups, year_windows, kl_pairs, js_pairs, js_nearest_year,
        js_mean_by_year_gap, topic_lowest_terms, topic_top_terms, topic_term_lines,
        topic_matrix_cells, topic_type_counts, topic_listing, doc_topic_scores, year_pair_arcs, lda_topics,
        lda_nearest_year,
    )
}
