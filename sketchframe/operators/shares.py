"""Additive shares of tables: split, combine, multiply.

Whole numbers live in a ring of 2^60 elements, so that a mask hides a value
completely and recombining is exact.  Products use real-valued shares, as the
triple identities only need addition.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchframe.functions.hashing import hash64, stream_key, uniform
from sketchframe.operators.joins import hstack
from sketchframe.session import maybe_broadcast

RING = 2**60
BASE = 16
MANTISSA_BITS = 53
TINY = 1e-200


def own_exponent(x: Column) -> Column:
    """Exponent of a double's own precision: floor((53 - e) / 4) for |x| in [2^(e-1), 2^e)."""
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    below = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).otherwise(guess)
    exact = F.when(F.pow(F.lit(2.0), below + 1) <= size, below + 1).otherwise(below)
    bits = F.lit(MANTISSA_BITS) - (exact + 1)
    return F.when(size == 0, F.lit(13)).otherwise(F.floor(bits / F.lit(4.0))).cast("int")


def settled(x: Column, exponent: int | Column | None, precision: float | None, max_exponent: int | None) -> tuple[Column, Column]:
    """The value to encode and its exponent.

    A size below 1e-200 counts as zero.  ``precision`` sets the exponent to the whole power of 16 that it reaches, so it is 256 for two
    digits behind the point; without either the value's own precision decides.  An exponent below ``max_exponent`` is raised to it.
    """
    if exponent is not None and precision is not None:
        raise ValueError("exponent and precision exclude each other")
    x = F.when(F.abs(x) < TINY, F.lit(0.0)).otherwise(x.cast("double"))
    if precision is not None:
        exponent = math.floor(math.log(precision, BASE))
    e = own_exponent(x) if exponent is None else F.lit(exponent) if isinstance(exponent, int) else exponent
    return x, (e if max_exponent is None else F.greatest(e, F.lit(max_exponent)))


def fixed_encode(
    x: Column, exponent: int | Column | None = None, ring: int = RING, precision: float | None = None, max_exponent: int | None = None
) -> Column:
    """STRUCT(encoding, exponent): round(x * 16^e) modulo the ring, negatives in its top half; see ``settled`` for e."""
    x, e = settled(x, exponent, precision, max_exponent)
    scaled = F.rint(x * F.pow(F.lit(float(BASE)), e))
    message = F.concat(F.lit("value does not fit the ring: "), x.cast("string"))
    whole = F.when(F.abs(scaled) <= F.lit(float(ring // 2)), scaled).otherwise(F.raise_error(message).cast("double"))
    return F.struct(
        F.pmod(whole.cast("bigint"), F.lit(ring)).alias("encoding"), e.cast("int").alias("exponent")
    )


def fixed_decode(encoding: Column, exponent: int | Column, ring: int = RING) -> Column:
    e = F.lit(exponent) if isinstance(exponent, int) else exponent
    if_bad = F.raise_error(F.lit("encoding outside the ring")).cast("bigint")
    signed = (
        F.when((encoding < 0) | (encoding >= ring), if_bad)
        .when(encoding <= ring // 2, encoding)
        .otherwise(encoding - F.lit(ring))
    )
    return signed.cast("double") * F.pow(F.lit(float(BASE)), -e)


def ring_mask(seed: int, party: str, *ids: str) -> Column:
    """Uniform ring element per cell, from the columns that identify it; it repeats, for tests."""
    return F.expr(f"shiftrightunsigned({hash64(stream_key(seed, 'mask', party), *ids)}, 4)")


def keyed_masks(spark: SparkSession, secret: str, party: str) -> Callable[..., Column]:
    """A function from whole-number id columns to uniform ring elements that only the holder of the secret can make again.

    The secret reaches the tasks as a broadcast, so neither the plan nor what Spark logs of it shows it.  A mask is a keyed digest of
    its ids, so a task that runs again makes the same one; a null id is an id of its own.
    """
    held = spark.sparkContext.broadcast(hashlib.sha256(secret.encode()).digest())
    tag = hashlib.sha256(party.encode()).digest()[:16]

    @F.pandas_udf("bigint")
    def mask(*ids: pd.Series) -> pd.Series:
        cells = np.ascontiguousarray(np.stack([i.to_numpy() for i in ids], axis=1).astype("<i8"))
        size, data = cells.shape[1] * 8, cells.tobytes()
        start = hashlib.blake2b(key=held.value, person=tag, digest_size=8)
        out = np.empty(len(cells), "<u8")
        for r in range(len(cells)):
            one = start.copy()
            one.update(data[r * size : (r + 1) * size])
            out[r] = int.from_bytes(one.digest(), "little")
        return pd.Series((out >> np.uint64(4)).astype(np.int64))

    # a null would turn its column into doubles on the way
    return lambda *ids: mask(*[c for i in ids for c in (F.col(i).isNull().cast("bigint"), F.coalesce(F.col(i).cast("bigint"), F.lit(0)))])


def share_split(
    df: DataFrame, exponent: int = 4, seed: int = 1, party: str = "", secret: str | None = None, column: str = "v"
) -> tuple[DataFrame, DataFrame]:
    """Two tables (row_id, f, share) that add up to the encoded value modulo the ring.

    Give it a dense table: every cell is masked, zeros too, so that neither
    share shows where the zeros are.  The mask is a function of the cell, so
    both tables are projections of the input without a shuffle.  Seeded masks are for tests; data takes a ``secret``.
    """
    cell = "row_id", "f"
    mask = ring_mask(seed, party, *cell) if secret is None else keyed_masks(df.sparkSession, secret, party)(*cell)
    encoded = fixed_encode(F.col(column), exponent)["encoding"]
    first = df.select("row_id", "f", mask.alias("share"))
    second = df.select("row_id", "f", F.pmod(encoded - mask, F.lit(RING)).alias("share"))
    return first, second


def reconstruct(a: DataFrame, b: DataFrame, exponent: int = 4) -> DataFrame:
    """(row_id, f, v) from two share tables."""
    summed = a.unionByName(b).groupBy("row_id", "f").agg(F.sum("share").alias("s"))
    return summed.select("row_id", "f", fixed_decode(F.pmod("s", F.lit(RING)), exponent).alias("v"))


class SharedDataset(NamedTuple):
    """What one party holds: shares of every column and of the labels."""

    x: DataFrame
    y: DataFrame


def share_dataset(
    xa: DataFrame, xb: DataFrame, y: DataFrame, n1: int, exponent: int = 4, seed: int = 1, secret: str | None = None
) -> tuple[SharedDataset, SharedDataset]:
    """Each party splits its own columns and passes one share on; labels come from A.

    The owner keeps the masked difference's counterpart: A holds the first
    share of everything, B the second.
    """
    a1, a2 = share_split(xa, exponent, seed, "A", secret)
    b1, b2 = share_split(xb, exponent, seed, "B", secret)
    cells = y.select("row_id", F.lit(0).cast("bigint").alias("f"), F.col("label").cast("double").alias("v"))
    y1, y2 = share_split(cells, exponent, seed, "Y", secret)
    return (
        SharedDataset(hstack(a1, b1, n1), y1.drop("f")),
        SharedDataset(hstack(a2, b2, n1), y2.drop("f")),
    )


# --- products of shared tables ----------------------------------------------


def real_mask(seed: int, stream: str, bound: float, *ids: str) -> Column:
    """Uniform multiple of 2^-16 in [-bound, bound)."""
    return F.expr(f"floor(({uniform(stream_key(seed, stream), *ids)} * 2 - 1) * {bound * 65536.0!r}D) / 65536.0D")


def real_split(df: DataFrame, value: str, ids: list[str], seed: int, stream: str, bound: float = 8.0) -> DataFrame:
    """The ids with two real shares ``a`` and ``b`` of ``value``."""
    mask = real_mask(seed, stream, bound, *ids)
    return df.select(*ids, mask.alias("a"), (F.col(value) - mask).alias("b"))


class Triples(NamedTuple):
    """Shared U(row_id, f), V(f, t), Z(row_id, t) = U V with columns a and b."""

    u: DataFrame
    v: DataFrame
    z: DataFrame


def _numbers(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))


def beaver_triples(cells: DataFrame, features: DataFrame, t: int = 1, seed: int = 1, bound: float = 8.0) -> Triples:
    """Random U over the given cells, V over the features, and their product.

    U and V are functions of their ids, so the product needs no join: V is
    evaluated next to U and summed by row.
    """
    u_value = real_mask(seed, "U", bound, "row_id", "f")
    v_value = real_mask(seed, "V", bound, "f", "t")
    u = cells.select("row_id", "f", u_value.alias("x"))
    v = features.select("f", _numbers(t).alias("t")).withColumn("x", v_value)
    fanned = u.select("row_id", "f", "x", _numbers(t).alias("t"))
    z = fanned.groupBy("row_id", "t").agg(F.sum(F.col("x") * v_value).alias("x"))
    return Triples(
        real_split(u, "x", ["row_id", "f"], seed, "U0", bound),
        real_split(v, "x", ["f", "t"], seed, "V0", bound),
        real_split(z, "x", ["row_id", "t"], seed, "Z0", bound),
    )


def transposed_triples(triples: Triples, rows: DataFrame, seed: int = 1, bound: float = 8.0) -> Triples:
    """V'(row_id, t) and Z'(f, t) = U' V' for the gradient, with the same U."""
    v_value = real_mask(seed, "Vp", bound, "row_id", "t")
    v = rows.select("row_id", F.lit(0).cast("bigint").alias("t")).withColumn("x", v_value)
    u = triples.u.select("row_id", "f", (F.col("a") + F.col("b")).alias("x"), F.lit(0).cast("bigint").alias("t"))
    z = u.groupBy("f", "t").agg(F.sum(F.col("x") * v_value).alias("x"))
    return Triples(
        triples.u,
        real_split(v, "x", ["row_id", "t"], seed, "Vp0", bound),
        real_split(z, "x", ["f", "t"], seed, "Zp0", bound),
    )


def _opened(x: DataFrame, u: DataFrame) -> DataFrame:
    """(row_id, f, xa, xb, e) with e = X - U opened: one grouped sum, no join."""
    zero = F.lit(0.0)
    mine = x.select("row_id", "f", F.col("a").alias("xa"), F.col("b").alias("xb"), (F.col("a") + F.col("b")).alias("e"))
    theirs = u.select("row_id", "f", zero.alias("xa"), zero.alias("xb"), (-(F.col("a") + F.col("b"))).alias("e"))
    sums = [F.sum(c).alias(c) for c in ("xa", "xb", "e")]
    return mine.unionByName(theirs).groupBy("row_id", "f").agg(*sums)


def _product(x: DataFrame, side: DataFrame, triples: Triples, inner: str, outer: str, bound_rows: int | None) -> DataFrame:
    """Shares of the product over ``inner``, one row per ``outer``."""
    v = triples.v.where(F.col("t") == 0).select(inner, F.col("a").alias("va"), F.col("b").alias("vb"))
    masked = side.join(maybe_broadcast(v, bound_rows), inner).select(
        inner, "a", "b", (F.col("a") + F.col("b") - F.col("va") - F.col("vb")).alias("o")
    )
    cells = _opened(x, triples.u).join(maybe_broadcast(masked, bound_rows), inner)
    first = F.col("xa") * F.col("o") + F.col("e") * F.col("a")
    second = F.col("xb") * F.col("o") + F.col("e") * F.col("b") - F.col("e") * F.col("o")
    terms = cells.select(outer, first.alias("a"), second.alias("b"))
    z = triples.z.where(F.col("t") == 0).select(outer, "a", "b")
    return terms.unionByName(z).groupBy(outer).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def beaver_matvec(x: DataFrame, w: DataFrame, triples: Triples, width: int | None = None) -> DataFrame:
    """Shares (row_id, a, b) of X w, from shared X(row_id, f, a, b) and w(f, a, b)."""
    return _product(x, w, triples, "f", "row_id", width)


def beaver_matvec_t(x: DataFrame, d: DataFrame, triples: Triples, m: int | None = None) -> DataFrame:
    """Shares (f, a, b) of X' d, from shared X and d(row_id, a, b)."""
    return _product(x, d, triples, "row_id", "f", m)
