"""Texts of an Arrow batch as flat bytes, and hashed words of them, without a loop over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# Bytes of text at a time: the arrays made of them take about a hundred times as much.
CHUNK = 1 << 18

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What a worker has from task to task under ``key``, until a ``lean`` task of another operator comes."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def drop_kept() -> None:
    """Give back what tasks before this have kept, and what Arrow has at hand."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def lean(run: Task) -> Task:
    """``run`` in a worker that has served other operators and goes on to more."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        yield from run(batches)
        drop_kept()

    return tidy

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + np.uint64(salt * int(_STEP) % 2**64))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


# Byte classes.  A word is a run of ASCII letters, digits and bytes of non-ASCII characters.
_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWERED = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_LETTER = ((_LOWERED >= 97) & (_LOWERED <= 122)) | (_BYTES >= 128)
_BLANK = (_BYTES <= 32) | (_BYTES == 127)
IS_WORD = _LETTER | _DIGIT
# Kinds of runs: 0 blank, 1 lower case and non-ASCII, 2 upper case, 3 digits, 4 anything else.
KIND = np.select([_BLANK, _UPPER, _LETTER, _DIGIT], [0, 2, 1, 3], 4).astype(np.uint8)
_CASED = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_FOLDED = _CASED[_LOWERED]

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        with np.errstate(over="ignore"):
            made = []
            for base in (_BASE, _INVERSE):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps))
        _powers = made[0], made[1]
    return _powers


def _of(total: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, wherever they stand."""
    value = (total[ends] - total[starts]) * inverse[starts]
    return mix(value ^ ((ends - starts).astype(np.uint64) * _STEP))


class Flat:
    """Some consecutive texts: their bytes and the offset of each."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def raw(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def _total(self, table: np.ndarray) -> np.ndarray:
        """Running sums of a polynomial over the bytes, modulo 2**64."""
        power, _ = _power(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(table[self.data] * power[: len(self.data)], out=total[1:])
        return total

    def _rows(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, starts, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every word in order; A-Z count as a-z."""
        return self._runs(IS_WORD[self.data].astype(np.uint8), _FOLDED)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every run of one kind of bytes; case counts."""
        return self._runs(KIND[self.data], _CASED)

    def words_cut(self, sizes: tuple[int, ...]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(0, hash, row) of all words, then (size, hash, row) of the first bytes of longer ones."""
        starts, ends = self._edges(IS_WORD[self.data].astype(np.uint8))
        power, inverse = _power(len(self.data) + 1)
        total = self._total(_FOLDED)
        row = self._rows(starts)
        parts = [(0, _of(total, inverse, starts, ends), row)]
        for size in sizes:
            long = ends - starts > size
            parts.append((size, _of(total, inverse, starts[long], starts[long] + size), row[long]))
        return parts

    def _runs(self, kind: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self._edges(kind)
        return _of(self._total(table), _power(len(self.data) + 1)[1], starts, ends), self._rows(starts)

    def _edges(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(kind):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.ones(len(kind) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[self.offsets] = True
        edges = np.flatnonzero(edge)
        starts, ends = edges[:-1], edges[1:]
        inside = kind[starts] != 0
        return starts[inside], ends[inside]


def flat(column: pa.Array, chunk: int = CHUNK) -> Iterator[Flat]:
    """Cut a string column into pieces of about ``chunk`` bytes; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + chunk, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield Flat(row, body[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the distinct runs of ``size`` words, sorted by row and shingle.

    A text of one to ``size - 1`` words has one shingle, made of all its words.
    """
    per_row = np.bincount(row, minlength=n_rows)
    last = np.cumsum(per_row)
    place = np.arange(len(h)) - np.repeat(last - per_row, per_row)
    length = np.minimum(per_row, size)[row]
    starts = np.flatnonzero(place + length <= per_row[row])
    length = length[starts]
    value = h[starts]
    for step in range(1, size):
        more = length > step
        value[more] = value[more] * np.uint64(_BASE) + h[starts[more] + step]
    value, row = mix(value), row[starts]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(value)))
