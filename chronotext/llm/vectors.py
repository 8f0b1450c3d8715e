"""Vectors from Arrow columns and the rows whose vectors can take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite(column: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~bad, F.lit(False))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """One row per vector; shorter vectors are filled with zeros, which change no product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    widest = max(int(lengths.max(initial=0)), width or 0)
    if len(lengths) and (lengths == widest).all():
        return values.reshape(len(lengths), widest)
    out = np.zeros((len(lengths), widest))
    out[np.arange(widest) < lengths[:, None]] = values
    return out


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns as the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def usable(vectors: DataFrame, *columns: str) -> DataFrame:
    return vectors.where(F.col("vec_id").isNotNull() & finite("embedding")).select("vec_id", "embedding", *columns)
