"""Helpers that the operators share: tables, Arrow texts, size-checked joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from chronotext.session import fits_broadcast

#: Bytes of text that a task works on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
#: Rows and bytes that go to a Python worker at a time.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def inline(spark: SparkSession, columns: list[str], rows) -> DataFrame:
    """A few constant rows of strings as literals of the plan."""
    structs = [F.struct(*[F.lit(value).alias(name) for name, value in zip(columns, row)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, from a session that hands long texts to Python in small batches; results do not depend on it."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(-?\d+)b?", conf.get(key, None) or "")
        if now and not 0 < int(now[1]) <= most:  # a size in other units was chosen by the user and stays
            conf.set(key, str(most))
    return df


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows with an id; a null text is an empty one."""
    named = small_batches(docs).where(F.col("doc_id").isNotNull())
    return named.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def with_text(batch: pa.RecordBatch, text: list) -> pa.RecordBatch:
    """``batch`` with other texts; its other columns stay as they are, whatever their types and nulls."""
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, batch.schema.field(at), pa.array(text, batch.schema.field(at).type))


def unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until it is none of ``columns``, which Spark compares without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a materialised ``right``: broadcast if its measured size allows, else a shuffle.

    The shuffled form is an equi-join whose hot keys adaptive execution splits.
    """
    return left.join(F.broadcast(right) if fits_broadcast(right) else right, on, how)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column, and where each begins (one offset more at the end)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return bytes_, offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``limit`` bytes: (first text, end, bytes, offsets)."""
    data, offsets = utf8(column)
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of the pieces of ``data`` between ``bounds`` (both in items of ``data``)."""
    places = pa.py_buffer((np.asarray(bounds, dtype=np.int64) * data.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, places, pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def lists(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds, dtype=np.int32)), pa.array(data))
