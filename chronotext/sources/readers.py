"""Readers: every input becomes a DataFrame with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronotext.functions.text import fields, html_content, html_title, leading_year
from chronotext.operators.arcs import parse_year_pairs
from chronotext.operators.topics import TIME_SLOTS
from chronotext.operators.years import sum_before
from chronotext.session import fits_broadcast, materialize

# Name patterns of the files read.
TOPIC_FILES = "topic-*-var-e-log-prob.dat"
TOPIC_FILE = r"topic-(\d+)-var-e-log-prob\.dat\z"
CLEAN_TEXT = r"([^/]*)_clean\.txt\z"

PAGE_SCHEMA = "title string, ns int, id bigint, revision struct<text:string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a text file or directory."""
    return spark.read.text(path)


def read_identified_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, value): lines with a unique id that grows with their place in a file.

    An id is (file, block, place): the hash of the file's path, where the split begins that holds the line, and
    the line's place among those that its task reads. All of it is known in the scan, so nothing is
    written, and reading the same files again with the same settings gives the same ids.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line = F.struct(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), place.alias("place")
    )
    return spark.read.text(path).select(line.alias("line_id"), "value")


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of all files of a directory numbered from 0, in the order of file names and in each file.

    The lines before a file are counted per file; that table has a row per file.
    """
    lines = materialize(
        spark.read.text(path).select(
            F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("place"), "value",
        )
    )
    numbered = number_lines(lines)
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines")).withColumn("all", F.lit(0))
    before = sum_before(sizes, "all", "file", "lines").select("file", F.col("_before").alias("_earlier"))
    return numbered.join(F.broadcast(before), "file").select((F.col("line") + F.col("_earlier")).alias("line"), "value")


def read_year_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, year, text) of the lines with at least two fields; further fields are ignored."""
    return parse_year_texts(read_identified_lines(spark, path)).withColumnRenamed("line_id", "doc_id")


def parse_year_texts(lines: DataFrame) -> DataFrame:
    keep = [name for name in lines.columns if name != "value"]
    parts = lines.select(*keep, fields("value").alias("_f")).where(F.size("_f") >= 2)
    return parts.select(*keep, F.get("_f", F.lit(0)).alias("year"), F.get("_f", F.lit(1)).alias("text"))


def read_table(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """A tab-separated file without header; every column is a string and quotes mean nothing."""
    schema = ", ".join(f"`{name}` string" for name in names)
    return (
        spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "").csv(path)
    )


def read_page_dump(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, content) from the XML export of a wiki, split by page."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(PAGE_SCHEMA).load(path)
    return pages.select(F.col("id").alias("page_id"), "title", F.col("revision.text").alias("content"))


def html_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, content) from (page_id, html)."""
    return pages.select(
        "page_id", html_title("html").alias("title"), html_content("html").alias("content")
    )


def read_listed_texts(spark: SparkSession, list_path: str, directory: str) -> tuple[DataFrame, DataFrame]:
    """(title, year, text) of the listed titles with a file ``<title>_clean.txt``, and the rest.

    The second frame holds the (title, year) without a file. The lines of a file are joined by
    one space.
    """
    listed = read_table(spark, list_path, "title", "year").withColumn("year", leading_year("year"))
    whole = F.regexp_replace(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n", " ")
    # Spark gives the name as part of a URL, in which a plus sign stands for itself.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    texts = (
        spark.read.option("pathGlobFilter", "*_clean.txt")
        .text(directory, wholetext=True)
        .select(F.regexp_extract(name, CLEAN_TEXT, 1).alias("title"), whole.alias("text"))
    )
    return listed.join(texts, "title"), listed.join(texts, "title", "left_anti")


def number_lines(lines: DataFrame, file: str = "file") -> DataFrame:
    """Add ``line``, the 0-based line number in each file, to materialised (file, split, place, ...).

    ``split`` orders the pieces of a file and ``place`` the lines of one piece. Lines are counted
    per piece and each piece starts where the ones before it end; only these counts are shuffled
    and no file goes through a single task.
    """
    pieces = lines.groupBy(file, "split").agg(
        F.count(F.lit(1)).alias("lines"), F.min("place").alias("first")
    )
    # Pieces are summed up inside ranges of (file, split), so a file of very many splits spans many tasks.
    starts = materialize(
        sum_before(pieces, file, "split", "lines").select(file, "split", (F.col("_before") - F.col("first")).alias("_start"))
    )
    if fits_broadcast(starts):
        starts = F.broadcast(starts)
    return lines.join(starts, [file, "split"]).withColumn("line", F.col("_start") + F.col("place")).drop("_start")


def read_topic_matrix(spark: SparkSession, directory: str, slots: int = TIME_SLOTS) -> DataFrame:
    """(topic, term_idx, time_idx, logp) from the topic files below a directory.

    Line k of a file is term ``k div slots`` at time ``k mod slots``; files of other names are
    skipped.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", TOPIC_FILES)
        .text(directory)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("place"),
            F.trim("value").try_cast("double").alias("logp"),
        )
        .where(F.col("file").rlike(TOPIC_FILE))
    )
    topic = F.regexp_extract("file", TOPIC_FILE, 1).cast("int").alias("topic")
    return number_lines(materialize(lines)).select(topic, *matrix_cell("line", slots), "logp")


def matrix_cell(line: str, slots: int = TIME_SLOTS) -> tuple[Column, Column]:
    """Term and time slot of a line number in a term-major matrix."""
    return (
        F.floor(F.col(line) / slots).cast("int").alias("term_idx"),
        (F.col(line) % slots).cast("int").alias("time_idx"),
    )


def parse_vocabulary(lines: DataFrame) -> DataFrame:
    """(idx, token) from ``idx,token`` lines; lines of another form go."""
    idx = F.split_part("value", F.lit(","), F.lit(1)).try_cast("bigint")
    token = F.split_part("value", F.lit(","), F.lit(2))
    return lines.select(idx.alias("idx"), token.alias("token")).where("idx IS NOT NULL")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return parse_vocabulary(spark.read.text(path))


def read_year_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(year1, year2, log_distance) from ``y1-y2,distance`` lines."""
    return parse_year_pairs(spark.read.text(path))
