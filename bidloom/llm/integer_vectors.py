"""Vectors as whole numbers: what both operators on quantised embeddings read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def usable(vector: Column) -> Column:
    """Not null, not empty, and all components finite numbers."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def quantised(vector: Column) -> Column:
    """Each component c as the whole number floor(256 * c); what a long cannot hold becomes its nearest end."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))


def common_length(rows: DataFrame, vector: str) -> int | None:
    """The number of components that most rows have (the larger one on a tie); None without rows."""
    counted = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    return counted.agg(F.max(F.struct("n", "d")).alias("top")).first()["top"]["d"] if not rows.isEmpty() else None


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of rows that all hold `dims` whole numbers, as int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)
