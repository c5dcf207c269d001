"""Row sketches: weighted min-hash samples, random Fourier and tensor features.

Plan shape of the sampled sketches.  A stored cell takes part in k draws, so a
table of (cell, draw) pairs is k times the input.  It is never built: each cell
meets ``BLOCK`` draws as aggregate columns, and only ceil(k / BLOCK) copies of
the cell exist.  Cells are first brought together by row with a rebalance,
which splits a row that is too heavy for one task; the partial aggregate then
leaves about one record per row and task, and that is all the second shuffle
moves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchframe.functions.hashing import below, normal, sign, stream_key, uniform
from sketchframe.operators.reshape import positive_part

BLOCK = 64
# Hash aggregation compiles its draws into one method, which must stay small.
HASHED_BLOCK = 16


def shared_uniforms(df: DataFrame, k: int, seed: int = 1, stream: str = "u", party: str = "", repeat: int = 1) -> DataFrame:
    """The table R(f, j, u) for the features that occur.

    Sketches do not read it, they evaluate the same expression in place.
    """
    draws = F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))
    key = stream_key(seed, stream, party, repeat)
    fanned = df.select("f").distinct().select("f", F.explode(draws).alias("j"))
    return fanned.select("f", "j", F.expr(uniform(key, "f", "j")).alias("u"))


def by_row(df: DataFrame) -> DataFrame:
    """Bring the cells of a row together, unless the row is too heavy for one task.

    Adaptive execution may split a rebalanced partition as long as nothing
    above relies on its layout.  Hashing the key first sees to that: the final
    aggregate gets its own exchange, which moves partial results only, and the
    partial one can run on any piece of a row.
    """
    return df.withColumn("_spread", F.xxhash64("row_id")).hint("rebalance", "_spread")


def _blocked(df: DataFrame, k: int, clustered: bool, block_size: int) -> tuple[DataFrame, list[str], int]:
    """Input with a block column, the draw numbers of one block, and its width."""
    if k < 1:
        raise ValueError("k must be positive")
    blocks = math.ceil(k / block_size)
    size = math.ceil(k / blocks)
    gathered = df if clustered else by_row(df)
    block = "0L" if blocks == 1 else f"explode(sequence(0L, {blocks - 1}L))"
    fanned = gathered.selectExpr("row_id", "f", "v", f"{block} as blk")
    return fanned, [f"(blk * {size}L + {t}L)" for t in range(size)], size


def _unfold(wide: DataFrame, values: list[str], size: int, k: int, name: str) -> DataFrame:
    """One output row per draw."""
    long = wide.selectExpr("row_id", "blk", f"posexplode(array({', '.join(values)})) as (t, {name})")
    return long.selectExpr("row_id", f"blk * {size}L + t as j", name).where(f"j < {k}")


def _smallest(
    df: DataFrame, rows: DataFrame, k: int, score: Callable[[str], str], clustered: bool, settle_ties: bool
) -> DataFrame:
    """Per row and draw the feature of least score; the least feature on ties.

    Every row adds one marker cell of feature -1 and score NaN, which sorts
    after all numbers: it wins only in a row without positive cells.
    """
    marker = rows.selectExpr("row_id", "-1L as f", "cast(null as double) as v")
    cells = positive_part(df).select("row_id", "f", "v").unionByName(marker)
    fanned, draws, size = _blocked(cells, k, clustered, BLOCK if settle_ties else HASHED_BLOCK)

    def least(j: str) -> str:
        a = f"coalesce({score(j)}, double('NaN'))"
        return f"min(struct({a} as a, f)).f" if settle_ties else f"min_by(f, {a})"

    wide = fanned.groupBy("row_id", "blk").agg(*[F.expr(f"{least(j)} as c{t}") for t, j in enumerate(draws)])
    return _unfold(wide, [f"c{t}" for t in range(size)], size, k, "s")


def _smallest_of_parties(df: DataFrame, rows: DataFrame, n1: int, k1: int, k2: int, score: Callable[[str], str], settle_ties: bool) -> DataFrame:
    """``_smallest`` for the owners of the columns below ``n1`` and of the rest, over one set of gathered cells.

    A block of draws belongs to one party and a cell meets its own party's blocks only, so the aggregate columns and the
    records exchanged are those of one table with ``k1 + k2`` draws.  Columns of the second party count from 0, and
    ``second`` tells the parties apart, also in ``score``.
    """
    if min(k1, k2) < 1:
        raise ValueError("both parties need draws")
    limit = BLOCK if settle_ties else HASHED_BLOCK
    blocks = math.ceil(k1 / limit), math.ceil(k2 / limit)
    size = max(math.ceil(k1 / blocks[0]), math.ceil(k2 / blocks[1]))
    cells = positive_part(df).selectExpr("row_id", f"f >= {n1}L as second", f"if(f >= {n1}L, f - {n1}L, f) as f", "v")
    marker = rows.selectExpr("row_id", "explode(array(false, true)) as second", "-1L as f", "cast(null as double) as v")
    own = f"explode(if(second, sequence(0L, {blocks[1] - 1}L), sequence(0L, {blocks[0] - 1}L))) as blk"
    fanned = by_row(cells.unionByName(marker)).selectExpr("row_id", "second", "f", "v", own)

    def least(j: str) -> str:
        a = f"coalesce({score(j)}, double('NaN'))"
        return f"min(struct({a} as a, f)).f" if settle_ties else f"min_by(f, {a})"

    draws = [F.expr(f"{least(f'(blk * {size}L + {t}L)')} as c{t}") for t in range(size)]
    wide = fanned.groupBy("row_id", "second", "blk").agg(*draws)
    long = wide.selectExpr("row_id", "second", "blk", f"posexplode(array({', '.join(f'c{t}' for t in range(size))})) as (t, s)")
    return long.selectExpr("row_id", "second", f"blk * {size}L + t as j", "s").where(f"j < if(second, {k2}L, {k1}L)")


def _key(seed: int, stream: str, parties: tuple[str, ...], repeat: int) -> int | str:
    """The stream key of one party, or SQL text that chooses between those of two."""
    keys = [stream_key(seed, stream, party, repeat) for party in parties]
    return keys[0] if len(keys) == 1 else f"if(second, {keys[1]}L, {keys[0]}L)"


def _minhash_score(seed: int, parties: tuple[str, ...], repeat: int) -> Callable[[str], str]:
    key = _key(seed, "u", parties, repeat)
    return lambda j: f"-ln({uniform(key, 'f', j)}) / v"


def _cws_score(seed: int, parties: tuple[str, ...], repeat: int) -> Callable[[str], str]:
    keys = {name: _key(seed, name, parties, repeat) for name in ("beta", "v1", "v2", "u1", "u2")}

    def score(j: str) -> str:
        # ln a instead of a: the same order with one factor less to evaluate,
        # as a = r exp(-g) / exp(g (t - beta)) for g = -ln(u1 u2), r = -ln(v1 v2).
        beta, v1, v2, u1, u2 = (uniform(key, "f", j) for key in keys.values())
        g = f"(-ln({u1} * {u2}))"
        return f"ln(-ln({v1} * {v2})) - {g} * (floor(ln(v) / {g} + {beta}) - {beta} + 1.0D)"

    return score


def p_minhash(
    df: DataFrame,
    rows: DataFrame,
    k: int,
    seed: int = 1,
    party: str = "",
    repeat: int = 1,
    clustered: bool = False,
    settle_ties: bool = True,
) -> DataFrame:
    """S(row_id, j, s): argmin of -ln(u) / v over the positive cells; -1 if there are none.

    Two rows agree on a draw with a chance equal to their probability Jaccard
    similarity.  ``clustered`` tells that a row's cells already share a task.

    A tie goes to the least feature, which needs a sorted aggregate.  Without
    ``settle_ties`` a hash aggregate does the work in about half the
    time, and one of two features with bitwise equal scores is taken.
    """
    return _smallest(df, rows, k, _minhash_score(seed, (party,), repeat), clustered, settle_ties)


def cws_0bit(
    df: DataFrame,
    rows: DataFrame,
    k: int,
    seed: int = 1,
    party: str = "",
    repeat: int = 1,
    clustered: bool = False,
    settle_ties: bool = True,
) -> DataFrame:
    """S(row_id, j, s) of consistent weighted sampling, keeping only the feature."""
    return _smallest(df, rows, k, _cws_score(seed, (party,), repeat), clustered, settle_ties)


PARTIES = ("A", "B")


def p_minhash_of_parties(df: DataFrame, rows: DataFrame, n1: int, k1: int, k2: int, seed: int = 1, settle_ties: bool = True) -> DataFrame:
    """S(row_id, second, j, s) of two parties' columns in one pass; each part is that party's own ``p_minhash``."""
    return _smallest_of_parties(df, rows, n1, k1, k2, _minhash_score(seed, PARTIES, 1), settle_ties)


def cws_0bit_of_parties(df: DataFrame, rows: DataFrame, n1: int, k1: int, k2: int, seed: int = 1, settle_ties: bool = True) -> DataFrame:
    """S(row_id, second, j, s) of two parties' columns in one pass; each part is that party's own ``cws_0bit``."""
    return _smallest_of_parties(df, rows, n1, k1, k2, _cws_score(seed, PARTIES, 1), settle_ties)


def one_based(samples: DataFrame) -> DataFrame:
    """Feature ids from 1; 0 marks an empty row."""
    return samples.withColumn("s", (F.col("s") + F.lit(1)).cast("bigint"))


def rff(
    df: DataFrame,
    rows: DataFrame,
    k: int,
    gamma: float,
    seed: int = 1,
    party: str = "",
    clustered: bool = False,
) -> DataFrame:
    """D(row_id, j, v): sqrt(2/k) cos(x.w_j + b_j), w ~ N(0, 2 gamma), b ~ U(0, 2 pi)."""
    radius, angle, phase = (stream_key(seed, name, party) for name in ("n1", "n2", "b"))
    spread = math.sqrt(2.0 * gamma)
    marker = rows.selectExpr("row_id", "0L as f", "0.0D as v")
    fanned, draws, size = _blocked(df.select("row_id", "f", "v").unionByName(marker), k, clustered, HASHED_BLOCK)
    dots = [F.expr(f"sum(v * ({normal(radius, angle, 'f', j)} * {spread!r}D)) as c{t}") for t, j in enumerate(draws)]
    wide = fanned.groupBy("row_id", "blk").agg(*dots)
    long = _unfold(wide, [f"c{t}" for t in range(size)], size, k, "z")
    turn = f"{uniform(phase, 'j')} * {2.0 * math.pi!r}D"
    return long.selectExpr("row_id", "j", f"{math.sqrt(2.0 / k)!r}D * cos(z + {turn}) as v")


def _convolve(k: int, degree: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function: circular convolution of each row's ``degree`` bucket vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = max(1, 4_000_000 // (k * degree))
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                part = batch.slice(start, chunk)
                lists = part.column("cells")
                entries = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                dense = np.zeros((part.num_rows, degree, k))
                d, bucket, x = (entries.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                dense[row, d, bucket] = x
                product = np.fft.rfft(dense, axis=2).prod(axis=1)
                out = np.fft.irfft(product, n=k, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_id"), pa.ListArray.from_arrays(np.arange(0, out.size + 1, k, dtype=np.int32), out.ravel())],
                    names=["row_id", "out"],
                )

    return run


def tensor_sketch(
    df: DataFrame,
    rows: DataFrame,
    k: int,
    gamma: float,
    n: int,
    coef0: float = 1.0,
    degree: int = 2,
    seed: int = 1,
    party: str = "",
) -> DataFrame:
    """D(row_id, j, v): sketch of the kernel (gamma <x, y> + coef0)^degree.

    The constant sqrt(coef0) is appended as feature ``n``.  Bucket sums are a
    grouped sum with map-side partials, after which a row has at most
    degree * k entries whatever its size; the convolution is a Fourier product
    per row, not a join of the row's buckets with each other.
    """
    constant = rows.selectExpr("row_id", f"{n}L as f", f"{math.sqrt(coef0)!r}D as v")
    scaled = df.selectExpr("row_id", "f", f"v * {math.sqrt(gamma)!r}D as v").unionByName(constant)

    def entry(d: int) -> str:
        bucket = below(stream_key(seed, f"h{d + 1}", party), k, "f")
        signed = f"{sign(stream_key(seed, f's{d + 1}', party), 'f')} * v"
        return f"struct({d} as d, cast({bucket} as int) as bucket, {signed} as x)"

    fanned = scaled.selectExpr("row_id", f"inline(array({', '.join(entry(d) for d in range(degree))}))")
    sums = fanned.groupBy("row_id", "d", "bucket").agg(F.sum("x").alias("x"))
    packed = sums.groupBy("row_id").agg(F.collect_list(F.struct("d", "bucket", "x")).alias("cells"))
    dense = packed.mapInArrow(_convolve(k, degree), "row_id bigint, out array<double>")
    return dense.select("row_id", F.posexplode("out").alias("j", "v")).withColumn("j", F.col("j").cast("bigint"))
