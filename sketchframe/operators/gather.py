"""Sums of vectors over all tasks of a pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Partial = Callable[[Iterator[pa.RecordBatch]], np.ndarray]


def task_sums(rows: DataFrame, partial: Partial, dtype: type = np.float64) -> np.ndarray:
    """Sum of the vectors that ``partial`` makes of each task's batches, all of one length.

    A task sends one row, however many it has read, and one task adds these.  They are added in the order of their bytes, so
    that a task which runs again or late changes no bit of the sum.  No rows give an empty vector.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = partial(batches).astype(dtype)
        yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()], pa.binary())], ["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted(p for batch in batches for p in batch.column("part").to_pylist())
        if parts:
            total = np.zeros(len(parts[0]) // np.dtype(dtype).itemsize, dtype)
            for p in parts:
                total += np.frombuffer(p, dtype)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    total = rows.mapInArrow(each, "part binary").repartition(1).mapInArrow(add, "part binary").collect()
    return np.frombuffer(total[0]["part"], dtype) if total else np.zeros(0, dtype)
