"""Samples to sparse one-hot sketches, plain or compressed.

All of it is column arithmetic on S(row_id, j, s) with 1-based samples; hash
coefficients are evaluated in place from j, so there is no join.  The result is
Z(row_id, col, v) with v = 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchframe.functions.hashing import below, stream_key
from sketchframe.operators.joins import hstack
from sketchframe.operators.reshape import split_width

# The hash seed does not follow the seed of the samples.
HASH_SEED = 1


def coefficients(c: int, j: str = "j", seed: int = HASH_SEED) -> tuple[str, str]:
    """SQL of a in [1, c) and b in [0, c) of draw ``j``."""
    if c < 2:
        raise ValueError("count compression needs c >= 2")
    return f"({below(stream_key(seed, 'a'), c - 1, j)} + 1L)", below(stream_key(seed, "b"), c, j)


def hash_coefficients(draws: DataFrame, c: int, seed: int = HASH_SEED) -> DataFrame:
    """H(j, a, b) for the given draws."""
    a, b = coefficients(c, seed=seed)
    return draws.selectExpr("j", f"{a} as a", f"{b} as b")


def _one_hot(samples: DataFrame, width: int, place: str) -> DataFrame:
    """Set one of ``width`` positions per sample, counted from the block's end."""
    column = f"{width}L * j + {width}L - ({place})"
    return samples.where("s > 0").selectExpr("row_id", f"{column} as col", "1 as v")


def sketch_plain(samples: DataFrame, n: int) -> DataFrame:
    """n positions per sample: column n j + n - s."""
    return _one_hot(samples, n, "s")


def sketch_count(samples: DataFrame, c: int, offset: int = 0, seed: int = HASH_SEED) -> DataFrame:
    """c positions per sample by (a s + b) mod c; ``offset`` shifts which a, b are used."""
    a, b = coefficients(c, f"j + {offset}L", seed)
    return _one_hot(samples, c, f"pmod({a} * pmod(s, {c}L) + {b}, {c}L) + 1L")


def sketch_bbit(samples: DataFrame, b: int) -> DataFrame:
    """2^b positions per sample by its b low bits."""
    size = 2**b
    return _one_hot(samples, size, f"pmod(s, {size}L) + 1L")


def expand(samples: DataFrame, n: int, b: int = 0, c: int = 0) -> DataFrame:
    """Plain for b = c = 0, count for c, low bits for b."""
    if b and c:
        raise ValueError("b and c exclude each other")
    if c:
        return sketch_count(samples, c)
    return sketch_bbit(samples, b) if b else sketch_plain(samples, n)


def sample_width(n: int, b: int = 0, c: int = 0) -> int:
    return c or (2**b if b else n)


def expand_two_party_global(
    a: DataFrame, b_samples: DataFrame, n1: int, n2: int, k1: int, b: int = 0, c: int = 0
) -> DataFrame:
    """One id space: B's features come after A's n1 and its draws after A's k1."""
    moved = b_samples.selectExpr("row_id", f"j + {k1}L as j", f"if(s > 0, s + {n1}L, s) as s")
    return expand(a.select("row_id", "j", "s").unionByName(moved), n1 + n2, b, c)


def party_width(n: int, b: int = 0, c: int = 0) -> int:
    """Positions per sample of one party; a domain no larger than c is not hashed."""
    return n if c and n <= c else sample_width(n, b, c)


def expand_two_party_blocks(
    a: DataFrame, b_samples: DataFrame, n1: int, n2: int, k1: int, b: int = 0, c: int = 0
) -> DataFrame:
    """A block of columns per party, side by side."""
    if b and c:
        raise ValueError("b and c exclude each other")

    def block(samples: DataFrame, n: int, offset: int) -> DataFrame:
        if c and n > c:
            return sketch_count(samples, c, offset)
        return sketch_bbit(samples, b) if b else sketch_plain(samples, n)

    return hstack(block(a, n1, 0), block(b_samples, n2, k1), party_width(n1, b, c) * k1, "col")


def expand_parties(samples: DataFrame, n1: int, n2: int, k1: int, b: int = 0, c: int = 0, blocks: bool = True) -> DataFrame:
    """Both parties' samples S(row_id, second, j, s), from 1, as one projection.

    The same columns as ``expand_two_party_blocks``, or without ``blocks`` as ``expand_two_party_global``.
    """
    if b and c:
        raise ValueError("b and c exclude each other")
    if not blocks:
        moved = samples.selectExpr("row_id", f"if(second, j + {k1}L, j) as j", f"if(second and s > 0, s + {n1}L, s) as s")
        return expand(moved, n1 + n2, b, c)

    return samples.where("s > 0").selectExpr("row_id", f"{party_column(n1, n2, k1, b, c)} as col", "1 as v")


def party_column(n1: int, n2: int, k1: int, b: int = 0, c: int = 0) -> str:
    """SQL for the column that a sample (second, j, s) of two parties' blocks lands in."""
    if b and c:
        raise ValueError("b and c exclude each other")

    def place(n: int, offset: int) -> str:
        if c and n > c:
            first, then = coefficients(c, f"j + {offset}L")
            return f"pmod({first} * pmod(s, {c}L) + {then}, {c}L) + 1L"
        return f"pmod(s, {2**b}L) + 1L" if b else "s"

    wide = party_width(n1, b, c), party_width(n2, b, c)
    columns = [f"{w}L * j + {w}L - ({place(n, o)})" for w, n, o in zip(wide, (n1, n2), (0, k1), strict=True)]
    return f"if(second, {columns[1]} + {wide[0] * k1}L, {columns[0]})"


def resplit_sketch(
    sketch: DataFrame, width: int, portion: float, align: str = "portion", boundary: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Cut an expanded sketch in two.

    ``align='portion'`` cuts at floor(width * portion), which need not be where
    the parties meet; ``align='party'`` cuts at the given ``boundary``.
    """
    if align == "party":
        if boundary is None:
            raise ValueError("align='party' needs the boundary")
        cut = boundary
    elif align == "portion":
        cut = split_width(width, portion)
    else:
        raise ValueError("align must be 'portion' or 'party'")
    left = sketch.where(F.col("col") < cut)
    right = sketch.where(F.col("col") >= cut).withColumn("col", F.col("col") - F.lit(cut).cast("bigint"))
    return left, right
