"""Vector columns: which rows take part, and their integers as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond this size are refused: sums of products would not be exact.
LARGEST = 1 << 27


def usable(vector: Column) -> Column:
    """Whether the vector is there, has entries, and all of them are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * entry), each entry taken as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def dimension(rows: DataFrame, column: str) -> int | None:
    """The one length of the vectors, None without rows; vectors of several lengths have no inner product."""
    low, high, least, most = rows.agg(
        F.min(F.size(column)), F.max(F.size(column)), F.min(F.array_min(column)), F.max(F.array_max(column))
    ).first()
    if low != high:
        raise ValueError(f"vectors have from {low} to {high} entries")
    if low is not None and max(-least, most) > LARGEST:
        raise ValueError(f"an entry is {max(-least, most)} after scaling; the largest allowed is {LARGEST}")
    return low


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column without nulls as rows of d integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, d)
