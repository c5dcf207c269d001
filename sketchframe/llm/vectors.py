"""Embedding tables: which rows count, and their entries as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vectors: DataFrame, *more: str) -> DataFrame:
    """(vec_id, vector array<double>, ...) of the rows whose vector is not null and has only finite entries.

    Vectors have one length; if a table mixes them, the commonest counts (of ties the longest) and rows of others are left out.
    """
    vector = F.col("embedding").cast("array<double>")
    sound = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector"), *more)
    rows = rows.where(F.col("vector").isNotNull() & sound)
    top = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.where(F.size("vector") == (top["width"] if top else -1))


def width_of(rows: DataFrame, column: str = "vector") -> int:
    """Length of the vectors of ``finite``; 0 for an empty table."""
    one = rows.select(F.size(column).alias("width")).first()
    return one["width"] if one else 0


def scaled_floor(vector: Column | str, scale: int, shift: int = 0) -> Column:
    """floor(scale * c) + shift of every entry, as array<bigint>; what is scaled beyond 2**62 counts as that."""
    edge = float(1 << 62)
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c * F.lit(float(scale)), F.lit(-edge)), F.lit(edge))) + F.lit(shift).cast("bigint"))


def matrix(column: pa.Array, width: int, dtype: type = np.int64) -> np.ndarray:
    """The lists of an Arrow column as a matrix; lists and entries are not null."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), width)
