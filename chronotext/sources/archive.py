"""A page archive: pages in order of their id in files of limited size, and an index of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronotext.operators.years import sum_before

# Pages of one file. Inside a file the id's page statistics rule out most of it.
BLOCK_PAGES = 16384


def write_archive(pages: DataFrame, path: str, block_pages: int = BLOCK_PAGES) -> None:
    """Write ``pages`` (page_id and any other columns that can be hashed) as an archive at ``path``, which must be new.

    Pages are sorted by id, equal ids by a hash of the rest, so an id of very many pages fills several
    files. The index, one row per file, has the ids that a file holds and the number of its first
    page. It is written last: a path without an index is no archive. Pages without an id come first;
    they have a number but are found by no id.
    """
    spark = pages.sparkSession
    tie = F.xxhash64(*[F.col(f"`{name}`") for name in pages.columns if name != "page_id"])
    ordered = pages.withColumn("_tie", tie).orderBy("page_id", "_tie")
    ordered.write.option("maxRecordsPerFile", block_pages).parquet(f"{path}/pages")
    placed = spark.read.parquet(f"{path}/pages").select("page_id", "_tie", F.col("_metadata.file_name").alias("file"))
    files = placed.groupBy("file").agg(
        F.count(F.lit(1)).alias("pages"),
        F.min("page_id").alias("low"),
        F.max("page_id").alias("high"),
        F.min(F.struct("page_id", "_tie", "file")).alias("start"),
    )
    numbered = sum_before(files.withColumn("all", F.lit(0)), "all", "start", "pages")
    index = numbered.select("file", "pages", "low", "high", F.col("_before").cast("long").alias("first"))
    index.orderBy("first").write.parquet(f"{path}/index")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All pages with their ``number``, counted from 0 in order of id."""
    starts = spark.read.parquet(f"{path}/index").select(F.col("file").alias("_file"), "first")
    return _pages(spark, path).join(starts, "_file").withColumn("number", F.col("first") + F.col("_row")).drop("_file", "_row", "first")


def archived_page(spark: SparkSession, path: str, page_id: int) -> DataFrame:
    """The pages of one id: none, one, or all that repeat it. Only the files that the index names are read.

    The driver gets the names of these files: one, unless the id is repeated on more pages than a file holds.
    """
    files = _files(spark, path, (F.col("low") <= page_id) & (F.col("high") >= page_id))
    return _pages(spark, path, files).where(F.col("page_id") == page_id).drop("_file", "_row")


def page_at(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The page of a number, or no row beyond the last. One file is read."""
    within = F.lit(number) - F.col("first")
    found = spark.read.parquet(f"{path}/index").where((within >= 0) & (within < F.col("pages"))).head(1)
    row = number - found[0]["first"] if found else -1
    return _pages(spark, path, [r["file"] for r in found]).where(F.col("_row") == row).drop("_file", "_row")


def _files(spark: SparkSession, path: str, wanted) -> list[str]:
    return [row["file"] for row in spark.read.parquet(f"{path}/index").where(wanted).select("file").collect()]


def _pages(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """Pages of some files, of all without a list, with their file and place in it."""
    folder = f"{path}/pages"
    whole = spark.read.parquet(folder)
    rows = spark.read.schema(whole.schema).parquet(*[f"{folder}/{name}" for name in files]) if files else whole
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")).drop("_tie")
    return placed.where(F.lit(False)) if files == [] else placed
