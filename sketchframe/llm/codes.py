"""Compression of vectors to short codes: a codebook for each part of the vectors, with memoised grid cells.

Entries become whole numbers, so distances, sums and codes are exact and do not depend on the order of rows.  A vector is cut
into equal parts; every part has its own codebook, which a fixed number of rounds improves.

Which entry is nearest is found by the coarse grid cell a part lies in.  A cell is a box, so each entry has a least and a
greatest distance to it.  An entry whose least distance is more than another's greatest is dominated: it is
nearest to no point of the box.  The others are remembered under the cell's hash, and only they are evaluated
for the points of that cell, exactly; a cell with one such entry needs no distance at all.  A task remembers up to ``HELD``
cells of a part and then begins anew; hashes are checked against the cell's place, and a point whose
cell shares its hash with another cell is compared with all entries.

Every round is one pass over a stored table of whole numbers.  A task sends the sums and counts of its parts by entry, so what
is gathered has ``parts * entries * (part width + 1)`` numbers, however many rows there are.

Defined cases: rows whose vector is null or holds a null or an entry that is not finite are left out, and so are, in tables of
mixed lengths, vectors of other lengths than the commonest.  A width that is no multiple of ``parts`` is filled up with
zeros.  The first codebook has fewer entries where there are fewer rows; null ids come last and rows of one id are ordered by their
entries.  Repeated rows count each.  A null label is a label.  An empty table gives none.  Entries of 2**26 or more after
scaling raise an error, as sums of squares would not be exact.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchframe.llm.text import mix
from sketchframe.llm.vectors import finite, matrix, width_of
from sketchframe.operators.gather import task_sums
from sketchframe.session import maybe_broadcast, write_out

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = 1 << 26
HELD = 1 << 16  # cells remembered by part in a task


# --- in a task --------------------------------------------------------------


class Cells:
    """Remembers which entries of one codebook may be nearest somewhere in a grid cell."""

    def __init__(self, book: np.ndarray, held: int = HELD):
        self.book, self.held = book, held
        spread = np.abs(book - book.mean(axis=0)).mean() if book.size else 0
        self.shift = max(int(spread).bit_length(), 1)  # a cell is about one to two mean deviations wide
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.places = np.zeros((0, self.book.shape[1]), np.int64)
        self.maybe = np.zeros((0, len(self.book)), bool)

    def _undominated(self, places: np.ndarray) -> np.ndarray:
        """For every cell, which entries are not dominated across its box."""
        low = places << self.shift
        high = low + (1 << self.shift) - 1
        least, greatest = np.zeros((2, len(places), len(self.book)), np.int64)
        for k, entry in enumerate(self.book):
            least[:, k] = (np.maximum(np.maximum(low - entry, entry - high), 0) ** 2).sum(axis=1)
            greatest[:, k] = (np.maximum(np.abs(low - entry), np.abs(high - entry)) ** 2).sum(axis=1)
        return least <= greatest.min(axis=1, keepdims=True)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """(point, entry): whether the entry may be the nearest one."""
        place = points >> self.shift
        h = np.zeros(len(place), np.uint64)
        for column in place.T:
            h = mix(h ^ column.view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) + len(own) > self.held:
            self._clear()
        at = np.searchsorted(self.hashes, own)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == own[known]
        if not known.all():
            new = place[first[~known]]
            hashes = np.append(self.hashes, own[~known])
            order = np.argsort(hashes)
            self.hashes = hashes[order]
            self.places = np.concatenate([self.places, new])[order]
            self.maybe = np.concatenate([self.maybe, self._undominated(new)])[order]
            at = np.searchsorted(self.hashes, own)
        at = at[back]
        return self.maybe[at] | (self.places[at] != place).any(axis=1, keepdims=True)

    def nearest(self, points: np.ndarray, wanted: bool) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every point, of ties the first, and its squared distance if ``wanted``."""
        maybe = self.candidates(points)
        entry, error = maybe.argmax(axis=1), np.zeros(len(points), np.int64)
        open_ = np.arange(len(points)) if wanted else np.flatnonzero(maybe.sum(axis=1) > 1)
        point, k = np.nonzero(maybe[open_])
        if len(point):
            distance = ((points[open_[point]] - self.book[k]) ** 2).sum(axis=1)
            least = np.minimum.reduceat(distance, np.flatnonzero(np.diff(point, prepend=-1)))
            hit = np.flatnonzero(distance == least[point])
            hit = hit[np.diff(point[hit], prepend=-1) > 0]  # the first of equal ones
            entry[open_], error[open_] = k[hit], least
        return entry, error


def _parts(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    """(part, row, position) of a batch of stored vectors."""
    raw = batch.column("cells")
    at = raw.offset * width * parts * 4
    data = np.frombuffer(raw.buffers()[2], np.int32, count=len(raw) * width * parts, offset=at) if len(raw) and width else np.zeros(0, np.int32)
    return data.reshape(len(raw), parts, width).transpose(1, 0, 2).astype(np.int64)


def _packed(scale: int, parts: int, size: int, width: int):
    """Store every vector as 32-bit whole numbers, filled up to ``parts * width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.floor(matrix(batch.column("vector"), size, np.float64) * scale)
            if value.size and np.abs(value).max() >= LARGEST:
                raise ValueError(f"entries must stay below {LARGEST / scale} in size")
            cells = np.zeros((len(value), parts * width), np.int32)
            cells[:, :size] = value
            column = pa.array([row.tobytes() for row in cells], pa.binary())
            yield pa.RecordBatch.from_arrays([column if c == "cells" else batch.column(c) for c in ("vec_id", "label", "cells")], ["vec_id", "label", "cells"])

    return run


def _gathered(books: np.ndarray, held: int):
    """Sums and counts by part and entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        cells = [Cells(book, held) for book in books]
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for p, points in enumerate(_parts(batch, parts, width)):
                entry, _ = cells[p].nearest(points, False)
                order = np.argsort(entry, kind="stable")
                some, first = np.unique(entry[order], return_index=True)
                total[p, some, 1:] += np.add.reduceat(points[order], first, axis=0) if len(some) else 0
                total[p, :, 0] += np.bincount(entry, minlength=entries)
        return total.ravel()

    return run


def _coded(books: np.ndarray, held: int):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book, held) for book in books]
        for batch in batches:
            code, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p, points in enumerate(_parts(batch, parts, width)):
                entry, distance = cells[p].nearest(points, True)
                code[:, p] = entry
                error += distance
            text = pa.array([row.tobytes().hex() for row in code], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


# --- Spark ------------------------------------------------------------------


def packed(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(vec_id, label, cells) of the rows that count, stored, and the width of a part."""
    rows = finite(vectors, "label")
    size = width_of(rows)
    width = -(-size // parts)
    kind = rows.schema["label"].dataType.simpleString()
    return write_out(rows.mapInArrow(_packed(scale, parts, size, width), f"vec_id bigint, label {kind}, cells binary"), "cells"), width


def fit(cells: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, held: int = HELD) -> np.ndarray:
    """Codebooks (part, entry, position) of a table of ``packed``."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two digits, so 1 to 256 entries")
    first = cells.orderBy(F.col("vec_id").asc_nulls_last(), F.hex("cells")).limit(entries).select("cells").collect()  # `entries` rows
    books = np.array([np.frombuffer(r.cells, np.int32).reshape(parts, width) for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if books.size else 0):
        total = task_sums(cells, _gathered(books, held), np.int64).reshape(*books.shape[:2], width + 1)
        count = total[:, :, :1]
        books = np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries as decimal numbers by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(cells: DataFrame, books: np.ndarray, held: int = HELD) -> DataFrame:
    """(vec_id, label, code, error) of every row of a table of ``packed``."""
    kind = cells.schema["label"].dataType.simpleString()
    return cells.mapInArrow(_coded(books, held), f"vec_id bigint, label {kind}, code string, error bigint")


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, held: int = HELD) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of the rows that count."""
    cells, width = packed(vectors, scale, parts)
    books = fit(cells, width, parts, entries, rounds, held)
    coded = write_out(encode(cells, books, held), "codes")
    totals = write_out(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    totals = maybe_broadcast(totals.withColumnRenamed("label", "_label"), totals.count())
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return joined.withColumn("codebooks_sha256", F.lit(digest(books)))
