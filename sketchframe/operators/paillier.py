"""Sums over an encrypted column by key.  Key pairs are inputs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchframe.operators.residues import LEAST, pieces, powers, residues

BASE = 16
# Partial products of one key are combined in this many groups before the last step.
SALTS = 256
# Distinct keys a task holds before it passes its products on.
HELD_KEYS = 50_000
# Rows of a key from which on their powers are taken together.
TOGETHER = 8
# Ciphertexts from which on they are first decrypted by one prime and checked by the other.
TOGETHER_OPENED = 2000
# Bytes that a worker's table of powers for blinding may take, exponent bits of a power at most, and values from which on it is made.
TABLE_BYTES, TABLE_BITS, TABLE_FROM = 32 << 20, 11, 2000


@dataclass(frozen=True)
class PublicKey:
    n: int

    @cached_property
    def square(self) -> int:
        return self.n * self.n

    @cached_property
    def size(self) -> int:
        return (self.square.bit_length() + 7) // 8

    def pack(self, c: int) -> bytes:
        return c.to_bytes(self.size, "big")


@dataclass(frozen=True)
class PrivateKey:
    p: int
    q: int

    @property
    def public(self) -> PublicKey:
        return PublicKey(self.p * self.q)


def _unpack(c: bytes) -> int:
    return int.from_bytes(c, "big")


class Blinder:
    """Powers of one fixed n-th residue, eight exponent bits per multiplication.

    Blinding by h^x with h = r^n needs the table once per worker instead of a
    full power per value.  Many values share a wider table of residues.
    """

    def __init__(self, key: PublicKey):
        self.n, self.square, self.seen = key.n, key.square, 0
        seed = hashlib.sha512(key.pack(key.n)).digest()
        base = pow(int.from_bytes(seed, "big") % key.n | 1, key.n, key.square)
        self.windows = []
        for _ in range((key.n.bit_length() + 7) // 8):
            powers = [1]
            for _ in range(255):
                powers.append(powers[-1] * base % self.square)
            self.windows.append(powers)
            base = powers[-1] * base % self.square

    def power(self, exponent: bytes) -> int:
        """h to the little-endian ``exponent``."""
        out = 1
        for powers, digit in zip(self.windows, exponent):
            out = out * powers[digit] % self.square
        return out

    @cached_property
    def table(self) -> list[np.ndarray]:
        """Powers of h in rows by groups of exponent bits; those of the first group are not times the residues' range."""
        by, bits = residues(self.square), 8 * len(self.windows)
        width = TABLE_BITS
        while width > 1 and (-(-bits // width) << width) * 16 * by.size > TABLE_BYTES:
            width -= 1
        base = by.times(by.enter([self.windows[0][1]]), by.raising)
        tables = []
        for at in range(0, bits, width):
            held = by.one if not at else by.times(by.one, by.raising)
            for _ in range(width):
                further = [by.times(held[:, piece], base) for piece in pieces(held.shape[1])]
                held, base = np.hstack([held, *further]), by.times(base, base)
            tables.append(np.ascontiguousarray(held.T))
        return tables

    def sealed(self, plain: list[int], exponents: list[bytes]) -> list[int]:
        """(1 + n * plain) * h^exponent for numbers from 0 to n - 1 and little-endian exponents, one as long as ``windows``."""
        self.seen += len(plain)
        if len(plain) < LEAST or self.seen < TABLE_FROM:
            return [(1 + self.n * x) * self.power(e) % self.square for x, e in zip(plain, exponents)]
        by, tables, out = residues(self.square), self.table, []
        width = len(tables[0]).bit_length() - 1
        for piece in pieces(len(plain)):
            bits = np.unpackbits(np.frombuffer(b"".join(exponents[piece]), np.uint8).reshape(-1, len(self.windows)), axis=1, bitorder="little")
            bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % width))).reshape(len(bits), -1, width)
            digits = bits @ (1 << np.arange(width))
            total, *others = (np.ascontiguousarray(np.take(table, digit, axis=0).T) for table, digit in zip(tables, digits.T))
            for power in others:
                by.times(total, power, total)
            number = by.times(by.enter(plain[piece], self.n) + by.one, by.raising)
            out += by.leave(by.times(total, number, total))
        return out


@lru_cache(maxsize=2)
def _blinder(key: PublicKey) -> Blinder:
    return Blinder(key)


class Opener:
    """Decryption modulo the squares of the two primes, whose results meet by the Chinese remainder theorem.

    A power takes numbers and exponents of half the length, so the two cost less than half of one modulo the square of n.
    """

    def __init__(self, key: PrivateKey):
        self.p, self.q, n = key.p, key.q, key.public.n
        self.sides = []
        for prime in (self.p, self.q):
            square = prime * prime
            self.sides.append((prime, square, pow((pow(1 + n, prime - 1, square) - 1) // prime, -1, prime)))
        self.join = pow(self.p, -1, self.q)

    def plain(self, c: int) -> int:
        """The number from 0 to n - 1 that ``c`` holds."""
        return self.plains([c])[0]

    def plains(self, cs: list[int]) -> list[int]:
        """The numbers that many ciphertexts hold.

        Numbers closer to 0 than half of p follow from one prime alone.  That they all are is seen from the other prime by one decryption:
        the product of the ciphertexts, each to a power of 64 bits taken from a digest of all of them, holds the sum of the numbers times these
        powers' exponents, and a wrong number passes once in 2^64 times.  If it does not hold that, all are decrypted by both primes.
        """
        left = self._side(cs, 0)
        if len(cs) >= TOGETHER_OPENED and self._agrees(cs, near := [a if 2 * a < self.p else a - self.p for a in left]):
            return [x % (self.p * self.q) for x in near]
        return [a + self.p * ((b - a) * self.join % self.q) for a, b in zip(left, self._side(cs, 1))]

    def _side(self, cs: list[int], which: int) -> list[int]:
        """The remainders of the numbers by one prime."""
        prime, square, h = self.sides[which]
        return [(x - 1) // prime * h % prime for x in powers(cs, prime - 1, square)]

    def _agrees(self, cs: list[int], plains: list[int]) -> bool:
        _, square, _ = self.sides[1]
        reduced = [c % square for c in cs]
        size = (square.bit_length() + 7) // 8
        seed = hashlib.sha512(b"".join([c.to_bytes(size, "little") for c in reduced])).digest()
        exponents = np.frombuffer(hashlib.shake_256(seed).digest(8 * len(cs)), np.uint8).reshape(-1, 8)
        total = sum(x * e for x, e in zip(plains, exponents.view("<u8").ravel().tolist()))
        return self._side([residues(square).combined(reduced, exponents)], 1) == [total % self.q]


class PowerProduct:
    """The product of c ** a over many (c, a), by buckets of digits.

    Ciphertexts may have different exponents: a digit's place counts from the point, so that the ones with fewer digits behind
    it land further up, which aligns them for nothing.
    """

    def __init__(self, square: int):
        self.square = square
        self.buckets: tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]] = ({}, {})
        self.exponent: int | None = None

    def add(self, c: int, a: int, exponent: int) -> None:
        self.exponent = exponent if self.exponent is None else max(self.exponent, exponent)
        held, a, place = self.buckets[a < 0], abs(a), -exponent
        while a:
            digit = a % BASE
            if digit:
                at = (place, digit)
                held[at] = held[at] * c % self.square if at in held else c
            a //= BASE
            place += 1

    def _raised(self, held: dict[tuple[int, int], int]) -> int:
        total = 1
        if held:
            for place in range(max(p for p, _ in held), -self.exponent - 1, -1):
                total = pow(total, BASE, self.square) if total != 1 else 1
                running = 1
                for digit in range(BASE - 1, 0, -1):
                    if (place, digit) in held:
                        running = running * held[place, digit] % self.square
                    if running != 1:
                        total = total * running % self.square
        return total

    def close(self) -> tuple[int, int]:
        """(ciphertext, exponent) of the product."""
        above, below = (self._raised(held) for held in self.buckets)
        return (above * pow(below, -1, self.square) % self.square if below != 1 else above), self.exponent


def encrypt_column(df: DataFrame, value: str, ids: list[str], key: PublicKey, secret: bytes, exponent: int = 4) -> DataFrame:
    """Replace ``value`` by (c BINARY, exponent INT).

    The blinding exponent of a row is a keyed digest of its ids, so a retried
    task writes the same ciphertext; the ids must be unique and the secret
    fresh per table.
    """
    keep = [c for c in df.columns if c != value]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("c", T.BinaryType()), T.StructField("exponent", T.IntegerType())])
    n, scale = key.n, BASE**exponent
    limit, length = n // 2, (n.bit_length() + 7) // 8

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blinder = _blinder(key)
        for frame in frames:
            plains = [round(x * scale) for x in frame[value].tolist()]
            if any(abs(plain) > limit for plain in plains):
                raise ValueError("value does not fit the key")
            rows = zip(plains, *(frame[i].tolist() for i in ids))
            blinds = [hashlib.shake_256(secret + repr(parts).encode()).digest(length) for _, *parts in rows]
            sealed = blinder.sealed([plain % n for plain in plains], blinds)
            yield frame[keep].assign(c=[key.pack(c) for c in sealed], exponent=exponent)

    return df.select(*keep, value).mapInPandas(run, schema)


def _multiply(frames: Iterable[pd.DataFrame], by: list[str], key: PublicKey) -> Iterator[pd.DataFrame]:
    """Products of the ciphertexts of each key, aligned to the largest exponent.

    Keys are held up to ``HELD_KEYS`` at a time and passed on early beyond that.
    """
    square = key.square
    held: dict[tuple, tuple[int, int]] = {}

    def flush() -> pd.DataFrame:
        columns = {name: [k[i] for k in held] for i, name in enumerate(by)}
        sealed = [key.pack(c) for c, _ in held.values()]
        out = pd.DataFrame({**columns, "c": sealed, "exponent": [e for _, e in held.values()]})
        held.clear()
        return out

    for frame in frames:
        for *group, c, e in zip(*(frame[name].tolist() for name in [*by, "c", "exponent"])):
            k, c = tuple(group), _unpack(c)
            if k in held:
                have, e0 = held[k]
                if e != e0:
                    top = max(e, e0)
                    c, have, e = pow(c, BASE ** (top - e), square), pow(have, BASE ** (top - e0), square), top
                c = c * have % square
            held[k] = (c, e)
        if len(held) > HELD_KEYS:
            yield flush()
    if held:
        yield flush()


def _multiply_sorted(frames: Iterable[pd.DataFrame], by: list[str], key: PublicKey) -> Iterator[pd.DataFrame]:
    """Products of the ciphertexts of each key where equal keys stand together; one key is held at a time."""
    square = key.square
    last: tuple | None = None

    def made(groups: list[tuple], cs: list[bytes], exponents: list[int]) -> pd.DataFrame:
        columns = {name: pd.Series(list(values), dtype=object) for name, values in zip(by, zip(*groups))}
        return pd.DataFrame({**columns, "c": cs, "exponent": exponents})

    for frame in frames:
        if frame.empty:
            continue
        groups = [*zip(*(frame[name].tolist() for name in by))]
        cs, exponents = frame["c"].tolist(), frame["exponent"].tolist()
        if last is not None:
            groups, cs, exponents = [last[0], *groups], [last[1], *cs], [last[2], *exponents]
        starts = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1])]
        runs = [*zip(starts, [*starts[1:], len(groups)])]
        tops = [max(exponents[a:b]) for a, b in runs]
        # the ones to be aligned, by how far
        late: dict[int, list[int]] = {}
        for (a, b), top in zip(runs, tops):
            for i in range(a, b):
                if exponents[i] < top:
                    late.setdefault(top - exponents[i], []).append(i)
        aligned = {}
        for far, at in late.items():
            aligned.update(zip(at, powers([_unpack(cs[i]) for i in at], BASE**far, square)))
        sealed = []
        for a, b in runs:
            if b - a == 1:
                sealed.append(cs[a])
                continue
            total, *others = (aligned[i] if i in aligned else _unpack(cs[i]) for i in range(a, b))
            for c in others:
                total = total * c % square
            sealed.append(key.pack(total))
        kept = [groups[a] for a in starts]
        last = kept.pop(), sealed.pop(), tops.pop()
        if kept:
            yield made(kept, sealed, tops)
    if last is not None:
        yield made([last[0]], [last[1]], [last[2]])


def paillier_sum(df: DataFrame, by: list[str], key: PublicKey, bound: float | None = None, *, few: bool = False) -> DataFrame:
    """Encrypted sum of a column per key: (by..., c, exponent).

    Ciphertexts are multiplied within each task before the shuffle, then in ``SALTS`` groups per key, then per
    key: a key that holds a third of the rows reaches the last step as at most ``SALTS`` records.  Each step is
    one stream over sorted partitions, however many keys there are.  With ``few``, for keys that mostly have a row or two, rows are
    exchanged once: only what repeats a key within a batch of rows is multiplied before, so a frequent key reaches the last step as a
    record a batch.  With ``bound``, the largest size of a value, a sum that might not fit the key raises an error.
    """
    fields = df.select(*by, "c", "exponent").schema
    if bound is not None:
        most = df.agg(F.count("*"), F.max("exponent")).first()
        if most[0] and most[0] * bound * BASE ** most[1] > key.n // 2:
            raise ValueError("the sum of so many values might not fit the key")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _multiply(frames, by, key)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if pa.Table.from_batches([batch]).group_by(by).aggregate([]).num_rows == batch.num_rows:
                yield batch
                continue
            for frame in _multiply([batch.to_pandas()], by, key):
                yield pa.RecordBatch.from_pandas(frame, schema=batch.schema, preserve_index=False)

    def streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _multiply_sorted(frames, by, key)

    rows = df.select(*by, "c", "exponent")
    if few:
        return rows.mapInArrow(repeated, fields).repartition(*by).sortWithinPartitions(*by).mapInPandas(streamed, fields)
    local = rows.mapInPandas(partial, fields)
    salted = local.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)))
    middle = salted.repartition(*by, "salt").sortWithinPartitions(*by).drop("salt").mapInPandas(streamed, fields)
    return middle.repartition(*by).sortWithinPartitions(*by).mapInPandas(streamed, fields)


def paillier_weighted_sum(df: DataFrame, weight: str, by: list[str], key: PublicKey, exponent: int = 0) -> DataFrame:
    """Encrypted sum of weight * value per key; weights are plain numbers.

    A task takes the powers of a key with several rows together (``PowerProduct``).
    """
    fields = df.select(*by, "c", "exponent").schema
    square = key.square

    def scale(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        few: dict[tuple, list[tuple[int, int, int]]] = {}
        many: dict[tuple, PowerProduct] = {}

        def flush() -> pd.DataFrame:
            out = [(*k, key.pack(pow(c, a % key.n, square)), e + exponent) for k, rows in few.items() for c, a, e in rows]
            for k, product in many.items():
                c, e = product.close()
                out.append((*k, key.pack(c), e + exponent))
            few.clear()
            many.clear()
            return pd.DataFrame(out, columns=[*by, "c", "exponent"], dtype=object)

        held = 0
        for frame in frames:
            for *group, c, e, a in zip(*(frame[name].tolist() for name in [*by, "c", "exponent", weight])):
                k, row = tuple(group), (_unpack(c), round(a * BASE**exponent), e)
                if k in many:
                    many[k].add(*row)
                    continue
                rows = few.setdefault(k, [])
                rows.append(row)
                held += 1
                if len(rows) == TOGETHER:
                    many[k] = PowerProduct(square)
                    for first in few.pop(k):
                        many[k].add(*first)
            if held > HELD_KEYS:
                yield flush()
                held = 0
        if few or many:
            yield flush()

    return paillier_sum(df.select(*by, "c", "exponent", weight).mapInPandas(scale, fields), by, key)


def decrypt_column(df: DataFrame, key: PrivateKey, value: str = "v") -> DataFrame:
    """Replace (c, exponent) by the decrypted ``value``."""
    keep = [c for c in df.columns if c not in ("c", "exponent")]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(value, T.DoubleType())])
    n, opener = key.public.n, Opener(key)
    limit = n // 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            plains = opener.plains([_unpack(c) for c in frame["c"]])
            out = [(plain if plain <= limit else plain - n) / BASE ** int(e) for plain, e in zip(plains, frame["exponent"])]
            yield frame[keep].assign(**{value: out})

    return df.select(*keep, "c", "exponent").mapInPandas(run, schema)
