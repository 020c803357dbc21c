"""Vectors of whole numbers from columns of floating-point ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of 2^26 or more fail the query: beyond it products of whole vectors could leave 64 bits.
LIMIT = 1 << 26


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, with x as double; a component of LIMIT or more fails the query."""
    value = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    checked = lambda y: F.when((y < LIMIT) & (y > -LIMIT), y).otherwise(F.raise_error(F.concat(F.lit("component too large: "), y.cast("string"))))
    return F.transform(F.transform(vector, value), lambda y: checked(y).cast("int"))


def matrix(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    """The batch's vectors as int64 rows."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def dimension(rows: DataFrame, vec_id: str, vector: str) -> int:
    """The length of the vector with the smallest id (of several the shortest; null ids last); 0 for no rows."""
    head = rows.select(vec_id, F.size(vector).alias("n")).orderBy(F.asc_nulls_last(vec_id), "n").first()
    return head.n if head else 0
