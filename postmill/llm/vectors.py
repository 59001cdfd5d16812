"""Vectors of an Arrow batch as a dense matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: the two columns that are read, whatever else a table has, with components as doubles; rows without vector go."""
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")


def dense(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows whose components are all finite, and these rows with zeros up to ``width`` (the longest, if None)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    bad = np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(flat)]
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    good = column.is_valid().to_numpy(zero_copy_only=False)
    good[bad] = False
    rows = np.flatnonzero(good)
    return rows, out if len(rows) == len(sizes) else out[rows]
