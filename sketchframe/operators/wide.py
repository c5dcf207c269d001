"""Fixed point in a ring of 2^120: two limbs of 60 bits each, added with carry.

A limb and its sums fit a BIGINT, so everything stays whole-number arithmetic on columns.  Sums over many rows add the
limbs apart, as decimals, and carry once at the end, which lets them pre-aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchframe.functions.hashing import hash64, stream_key
from sketchframe.operators.shares import BASE, keyed_masks, settled

BITS = 60
LIMB = 2**BITS


def _pair(hi: Column, lo: Column) -> Column:
    """Limbs below 2^63 in size brought into the ring: what ``lo`` has above 60 bits, or lacks, moves to ``hi``."""
    carry = F.shiftright(lo, BITS)  # rounds down, also below zero
    return F.struct((hi + carry).bitwiseAND(LIMB - 1).alias("hi"), lo.bitwiseAND(LIMB - 1).alias("lo"))


def wide_encode(x: Column, exponent: int | Column | None = None, precision: float | None = None, max_exponent: int | None = None) -> Column:
    """STRUCT(hi, lo, exponent): round(x * 16^e) modulo 2^120, negatives in the top half."""
    x, e = settled(x, exponent, precision, max_exponent)
    scaled = F.rint(x * F.pow(F.lit(float(BASE)), e))
    message = F.concat(F.lit("value does not fit the ring: "), x.cast("string"))
    whole = F.when(F.abs(scaled) < F.lit(2.0 ** (2 * BITS - 1)), scaled).otherwise(F.raise_error(message).cast("double"))
    size = F.abs(whole)  # a small negative number would not be exact below a limb's border
    above = F.floor(size / F.lit(float(LIMB)))
    below = size - above.cast("double") * F.lit(float(LIMB))
    plain = F.struct(above.cast("bigint").alias("hi"), below.cast("bigint").alias("lo"))
    limbs = F.when(whole < 0, wide_negative(plain)).otherwise(plain)
    return F.struct(limbs["hi"].alias("hi"), limbs["lo"].alias("lo"), e.cast("int").alias("exponent"))


def wide_negative(a: Column) -> Column:
    return _pair(-a["hi"], -a["lo"])


def wide_add(a: Column, b: Column) -> Column:
    return _pair(a["hi"] + b["hi"], a["lo"] + b["lo"])


def wide_subtract(a: Column, b: Column) -> Column:
    return _pair(a["hi"] - b["hi"], a["lo"] - b["lo"])


def wide_align(a: Column, exponent: Column, to: Column | int) -> Column:
    """The same number with a larger exponent: both limbs move up by four bits a step."""
    s = ((F.lit(to) if isinstance(to, int) else to) - exponent) * 4
    move = lambda x, n: F.call_function("shiftleft", x, n.cast("int")).bitwiseAND(LIMB - 1)
    near = F.struct(
        move(a["hi"], s).bitwiseOR(F.call_function("shiftright", a["lo"], (F.lit(BITS) - s).cast("int"))).alias("hi"),
        move(a["lo"], s).alias("lo"),
    )
    far = F.struct(move(a["lo"], s - BITS).alias("hi"), F.lit(0).cast("bigint").alias("lo"))
    zero = F.lit(0).cast("bigint")
    bad = F.raise_error(F.lit("an exponent cannot shrink")).cast("bigint")
    return (
        F.when(s < 0, F.struct(bad.alias("hi"), zero.alias("lo")))
        .when(s == 0, F.struct(a["hi"].alias("hi"), a["lo"].alias("lo")))
        .when(s < BITS, near)
        .when(s < 2 * BITS, far)
        .otherwise(F.struct(zero.alias("hi"), zero.alias("lo")))
    )


def wide_decode(a: Column, exponent: int | Column) -> Column:
    """The double nearest to the number."""
    e = F.lit(exponent) if isinstance(exponent, int) else exponent
    below_zero = a["hi"] >= LIMB // 2
    size = F.when(below_zero, wide_negative(a)).otherwise(F.struct(a["hi"].alias("hi"), a["lo"].alias("lo")))
    whole = (size["hi"].cast("decimal(19,0)") * F.lit(LIMB).cast("decimal(19,0)") + size["lo"].cast("decimal(19,0)")).cast("double")
    return F.when(below_zero, -whole).otherwise(whole) * F.pow(F.lit(float(BASE)), -e)


def wide_sum(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., value): the ring sum of a STRUCT(hi, lo) column per key."""
    limb = lambda name: F.sum(F.col(value)[name].cast("decimal(28,0)"))
    sums = df.groupBy(*by).agg(limb("hi").alias("_hi"), limb("lo").alias("_lo"))
    base = F.lit(LIMB).cast("decimal(20,0)")
    lo = (F.col("_lo") % base).cast("bigint")
    carry = ((F.col("_lo") - lo.cast("decimal(20,0)")) / base).cast("decimal(38,0)")
    hi = ((F.col("_hi") + carry) % base).cast("bigint")
    return sums.select(*by, F.struct(hi.alias("hi"), lo.alias("lo")).alias(value))


def wide_split(df: DataFrame, exponent: int = 8, seed: int = 1, party: str = "", secret: str | None = None, column: str = "v") -> tuple[DataFrame, DataFrame]:
    """Two tables (row_id, f, share STRUCT(hi, lo)) that add up to the encoded value in the ring; see ``share_split``."""
    cell, limbs = ("row_id", "f"), {}
    for name in ("hi", "lo"):
        if secret is None:
            limbs[name] = F.expr(f"shiftrightunsigned({hash64(stream_key(seed, f'mask {name}', party), *cell)}, 4)")
        else:
            limbs[name] = keyed_masks(df.sparkSession, secret, f"{party} {name}")(*cell)
    masked = df.select(*cell, F.struct(*[c.alias(n) for n, c in limbs.items()]).alias("mask"), wide_encode(F.col(column), exponent).alias("code"))
    first = masked.select(*cell, F.col("mask").alias("share"))
    return first, masked.select(*cell, wide_subtract(F.col("code"), F.col("mask")).alias("share"))


def wide_reconstruct(a: DataFrame, b: DataFrame, exponent: int = 8) -> DataFrame:
    """(row_id, f, v) from two share tables."""
    summed = wide_sum(a.unionByName(b), "share", ["row_id", "f"])
    return summed.select("row_id", "f", wide_decode(F.col("share"), exponent).alias("v"))
