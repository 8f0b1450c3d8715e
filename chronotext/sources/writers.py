"""Writers: text directories, the vocabulary lookup, sparse documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronotext.functions.text import sparse_line
from chronotext.operators.words import vocabulary_lines
from chronotext.session import materialize


def write_lines(lines: DataFrame, path: str, overwrite: bool = True) -> None:
    """Write one string column as text; without ``overwrite`` an existing path is an error."""
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_tsv(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """Write the columns as tab-separated text, NULL as an empty field."""
    cells = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in df.columns]
    write_lines(df.select(F.concat_ws("\t", *cells).alias("value")), path, overwrite)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """Write ``idx,token`` lines in index order.

    The sort is distributed: a small vocabulary ends up in one file, and the files of a large one,
    joined in the order of their names, are the lookup.
    """
    write_lines(vocabulary_lines(vocab.orderBy("idx")), path)


def sparse_lines(documents: DataFrame) -> DataFrame:
    """``year<TAB>n idx:n idx:n ...`` per document."""
    return documents.select(
        F.concat(F.col("year").cast("string"), F.lit("\t"), sparse_line("terms")).alias("value")
    )


def write_trainer_documents(documents: DataFrame, path: str) -> None:
    """Write ``n idx:n idx:n ...`` per document without its year, in order of year and then of id, as topic trainers want them.

    The sort is distributed; the files in the order of their names are the input of the trainer.
    """
    key = documents.columns[0]
    # Written before the sort, which reads its input twice, once to find the ranges.
    lines = materialize(documents.select("year", key, sparse_line("terms").alias("value")))
    write_lines(lines.orderBy("year", key).select("value"), path)


def write_sparse_documents(documents: DataFrame, path: str, by_year: bool = False) -> None:
    """Write sparse documents, on request in year order as topic trainers want them."""
    ordered = documents.orderBy("year", documents.columns[0]) if by_year else documents
    write_lines(sparse_lines(ordered), path)
