"""Dense numeric text (comma separated lines) read as sparse cells.

A line may be wider than a batch should be, so it leaves the JVM in pieces of fixed size, in order.  The scanner walks
over the pieces of a task: it looks for the bytes 1 to 9 and for commas, both at the speed of numpy, and only cells with such
a byte are turned into numbers.  The Python work is therefore linear in the cells that are not zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchframe.sources.svmlight import numbered_lines

PIECE = 8192
CELLS = "row_id bigint, col bigint, v double"


class Scanner:
    """Cells (col, value) of one line that comes in pieces; holds at most the cell that a piece ends in."""

    def __init__(self) -> None:
        self.col, self.rest = 0, b""

    def feed(self, piece: bytes, last: bool) -> tuple[np.ndarray, np.ndarray]:
        data = self.rest + piece
        if not last:
            end = data.rfind(b",") + 1
            data, self.rest = data[:end], data[end:]
        raw = np.frombuffer(data, np.uint8)
        commas = np.flatnonzero(raw == ord(","))
        marks = np.flatnonzero((raw - np.uint8(ord("1")) < 9) | (raw > ord("9")))  # digits but 0, and letters such as nan
        cell = np.unique(np.searchsorted(commas, marks))
        start = np.where(cell > 0, commas[cell - 1] + 1, 0) if len(commas) else np.zeros(len(cell), np.int64)
        stop = np.append(commas, len(raw))[cell]
        single = stop - start == 1
        value = np.zeros(len(cell))
        value[single] = raw[start[single]].astype(np.float64) - ord("0")
        for i in np.flatnonzero(~single):
            value[i] = float(data[start[i] : stop[i]])
        cols = cell + self.col
        self.col += len(commas)
        there = value != 0
        return cols[there], value[there]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        if not batch.num_rows:
            continue
        row, last = batch.column("row_id").to_pylist(), batch.column("last").to_pylist()
        found = []
        for r, is_last, piece in zip(row, last, batch.column("piece"), strict=True):
            cols, values = scanner.feed(piece.as_py(), is_last)
            found.append((np.full(len(cols), r, np.int64), cols, values))
            if is_last:
                scanner = Scanner()
        arrays = [np.concatenate(part) for part in zip(*found, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["row_id", "col", "v"])


def read_dense_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(row_id, col, v) of the cells that are not zero; lines are numbered from 0 in file order.

    Numbers may be written in any way Python reads (``1``, ``0.5``, ``1.0e+00``, ``nan``); what is none raises an error.  An empty line is a
    row without cells and keeps its number.
    """
    lines = numbered_lines(spark, path).select("row_id", F.col("value").cast("binary").alias("value"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length("value")), F.lit(PIECE))
    pieces = F.transform(starts, lambda s: F.struct(F.substring("value", s, F.lit(PIECE)).alias("piece"), (s + PIECE > F.octet_length("value")).alias("last")))
    cut = lines.select("row_id", F.explode(pieces).alias("p")).select("row_id", "p.piece", "p.last")
    return cut.mapInArrow(_scan, CELLS)
