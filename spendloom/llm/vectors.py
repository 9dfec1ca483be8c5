"""What the vector operators share: which vectors count, classes of equal vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is not null, not zero, and has only finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def with_class_key(df: DataFrame, vector: str) -> DataFrame:
    """Adds h1 and h2, two hashes that equal vectors share (and no others, but for a chance of about 2 ** -128)."""
    return df.withColumns({"h1": F.xxhash64(F.lit(1), vector), "h2": F.xxhash64(F.lit(2), vector)})


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))
