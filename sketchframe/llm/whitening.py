"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

The components are the right singular vectors of the centred fit list X, one row for each distinct vector.  A step
takes a direction v, gives the left vector u = Xv less its share in the earlier ones, and from it the next direction
X'u less its share in the earlier ones: alternating products with X and X', whose coefficients form
a bidiagonal matrix.  Its small singular value decomposition yields components and deviations.

X stays where it is, in a stored table of blocks of rows.  A left vector has an entry per row of X and is never
stored or moved: every u is X times a known combination of directions, so a task makes its piece of all left vectors again from its rows.
One pass over the blocks returns Xv's products with the left vectors, its length, and X'Xv; that is all a
step needs, and it is as long as a vector is wide.  Reorthogonalisation is full on both sides.  Where the rest of Xv is small
against Xv, a second pass makes up for the digits that cancel.

Steps go on until the residuals of the wanted components are rounding errors and what X has beside them is too little for
another as large, so that none is missed; at the latest after as many as a vector is wide, when the decomposition is complete.  Where a product vanishes, as with repeated deviations or fewer rows than columns, the next direction is
a new one, orthogonal to the earlier ones, so that components that one starting direction cannot see are found too.

Whole numbers are centred exactly: n * x - S is computed in integers before anything is divided.

Defined cases: rows whose vector is null or holds a null or an entry that is not finite are left out, and so are, in tables of
mixed lengths, vectors of other lengths than the commonest.  Rows that repeat an id or a vector give a result each, while a vector
counts once in the fit.  Null ids stay null.  There are min(16, width) components; the sign of each makes its largest entry
positive.  A component without variance has explained 0 (null where all have none) and whitened null and is no part of identity_error, which is
null if there are no others.  A deviation beyond the range of a long is null; scaled entries beyond 2**62 count
as that.  An empty table gives none.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchframe.llm.vectors import finite, matrix, scaled_floor, width_of
from sketchframe.operators.gather import task_sums
from sketchframe.session import write_out

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
BLOCK_CELLS = 1 << 18  # cells of a stored block, 2 MB
AGAIN = 0.1  # share of a squared length below which a second pass is made


@dataclass(frozen=True)
class Fit:
    """Components by column, their eigenvalues by falling size, and what the fit list adds up to."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None


# --- in a task --------------------------------------------------------------


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(BLOCK_CELLS // max(width, 1), 1)
        for batch in batches:
            cells = matrix(batch.column("x"), width)
            for start in range(0, len(cells), rows):
                some = cells[start : start + rows]
                total = [sum(map(int, column)) for column in some.T] if some.size and np.abs(some).max() > 1 << 40 else some.sum(axis=0).tolist()
                columns = [pa.array([some.tobytes()], pa.binary()), pa.array([len(some)], pa.int64()), pa.array([list(map(str, total))], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["block", "n", "sums"])

    return run


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in double precision: the whole part of the mean is taken off in integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - n * (s // n)) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over the columns of (n * x - S) ** 2; None beyond the range of a long."""
    bound = float(np.abs(centred(x, n, sums)).max(initial=0.0)) * n
    if bound * bound * max(x.shape[1], 1) < 2.0**62 and n * float(np.abs(x).max(initial=0)) < 2.0**62 and max(map(abs, sums), default=0) < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [d if d < 2**63 else None for d in exact]


def _products(n: int, sums: list[int], left: np.ndarray, v: np.ndarray):
    """(U'Xv, |Xv|**2, X'Xv) with U = X left, over the task's blocks."""
    width = len(v)

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        shares, length, back = np.zeros(width), 0.0, np.zeros(width)
        for batch in batches:
            for raw in batch.column("block"):
                x = centred(np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, width), n, sums)
                t = x @ v
                shares[: left.shape[1]] += (x @ left).T @ t
                length += t @ t
                back += x.T @ t
        return np.concatenate([shares, [length], back])

    return run


def _moments(n: int, sums: list[int], project: np.ndarray):
    """Squared length of all rows, then sums and products of the projected rows."""
    width, k = project.shape

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        length, total, product = 0.0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for raw in batch.column("block"):
                x = centred(np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, width), n, sums)
                w = x @ project
                length += (x * x).sum()
                total += w.sum(axis=0)
                product += w.T @ w
        return np.concatenate([[length], total, product.ravel()])

    return run


def _projected(n: int, sums: list[int], project: np.ndarray, sound: np.ndarray):
    width = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            w = centred(x, n, sums) @ project
            flat = pa.array(w.ravel(), mask=np.tile(~sound, len(w)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(x, n, sums), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return run


# --- the small side ---------------------------------------------------------


def _apart(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` less its share in the columns of ``basis``, twice over."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def _fresh(basis: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    v = _apart(rng.standard_normal(width), basis)
    return v / np.linalg.norm(v)


def bidiagonalise(products, width: int, wanted: int, scale: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(components by column, singular values) of an operator X of ``width`` columns.

    ``products(left, v)`` is (U'Xv, |Xv|**2, X'Xv) with U = X left; ``scale`` is the length of X, against which a number is
    called a rounding error.
    """
    rng = np.random.default_rng(seed)
    tiny = 1e-13 * scale
    right, left, back = (np.zeros((width, 0)) for _ in range(3))  # V, A with U = XA, and X'U
    alphas: list[float] = []
    betas: list[float] = []
    v = _fresh(right, width, rng)
    while True:
        right = np.column_stack([right, v])
        combination = v
        shares, length, g = products(left, combination)
        combination, g, rest = combination - left @ shares, g - back @ shares, length - shares @ shares
        if rest < AGAIN * length and length > tiny * tiny:
            shares, length, g = products(left, combination)
            combination, g, rest = combination - left @ shares, g - back @ shares, length - shares @ shares
        alpha = float(np.sqrt(max(rest, 0.0)))
        if alpha <= tiny:
            alpha, combination, g = 0.0, np.zeros(width), np.zeros(width)
        else:
            combination, g = combination / alpha, g / alpha
        alphas.append(alpha)
        left, back = np.column_stack([left, combination]), np.column_stack([back, g])
        k = len(alphas)
        small = np.diag(alphas) + np.diag(betas, 1)
        p, s, q = np.linalg.svd(small)
        if k == width:
            break
        v = _apart(g, right)
        beta = float(np.linalg.norm(v))
        if alpha == 0.0 or beta <= tiny:
            beta = 0.0
        unseen = scale * scale - float((small * small).sum()) - beta * beta  # bounds the square of any other singular value
        if k >= wanted and unseen < s[wanted - 1] ** 2 and (beta * np.abs(p[-1, :wanted])).max() <= tiny / 100:
            break
        betas.append(beta)
        v = _fresh(right, width, rng) if beta == 0.0 else v / beta
    found = right @ q.T[:, :wanted]
    return found / np.linalg.norm(found, axis=0), s[:wanted]


# --- Spark ------------------------------------------------------------------


def quantised(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x array<bigint>) of the rows that count."""
    return finite(vectors).select("vec_id", scaled_floor("vector", scale, shift).alias("x"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of the distinct vectors of ``rows(vec_id, x)``; None if there are none."""
    width = width_of(rows, "x")
    distinct = rows.select("x").distinct()
    blocks = write_out(distinct.mapInArrow(_blocks(width), "block binary, n bigint, sums array<string>"), "blocks")
    n = blocks.agg(F.sum("n")).first()[0]
    if not n or not width:
        return None
    by_place = blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r.s) for r in by_place.orderBy("at").collect()]  # one number for each column
    only = blocks.select("block")
    scale2 = float(task_sums(only, _moments(n, sums, np.zeros((width, 0))), np.float64)[0])

    def products(left: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        total = task_sums(only, _products(n, sums, left, v), np.float64)
        return total[: left.shape[1]], float(total[width]), total[width + 1 :]

    wanted = min(components, width)
    if scale2 == 0.0:
        return Fit(n, sums, np.eye(width)[:, :wanted], np.zeros(wanted), 0.0, None)
    found, singular = bidiagonalise(products, width, wanted, np.sqrt(scale2))
    found = found * np.where(np.take_along_axis(found, np.abs(found).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)
    e = singular**2 / n
    e = np.where(e > 1e-20 * scale2 / n, e, 0.0)
    sound = e > 0
    made = task_sums(only, _moments(n, sums, found[:, sound] / np.sqrt(e[sound])), np.float64)
    k = int(sound.sum())
    mean = made[1 : k + 1] / n
    covariance = made[k + 1 :].reshape(k, k) / n - np.outer(mean, mean)
    return Fit(n, sums, found, e, scale2 / n, float(np.abs(covariance - np.eye(k)).max()))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per row that counts and component."""
    rows = quantised(vectors, scale, shift)
    found = fit(rows, components)
    if found is None:
        empty = "cast(null as bigint) as vec_id, 0 as component, 0L as n, 0L as deviation, 0D as whitened, 0D as explained, 0D as identity_error"
        return rows.sparkSession.range(0).selectExpr(*[c.strip() for c in empty.split(",")])
    sound = found.eigenvalues > 0
    project = found.components / np.sqrt(np.where(sound, found.eigenvalues, 1.0))
    made = rows.mapInArrow(_projected(found.n, found.sums, project, sound), "vec_id bigint, deviation bigint, whitened array<double>")
    share = F.array(*[F.lit(float(e / found.trace) if found.trace else None).cast("double") for e in found.eigenvalues])  # at most `components`
    long = made.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return long.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation", "whitened",
        share[F.col("place")].alias("explained"), F.lit(found.identity_error).cast("double").alias("identity_error"),
    )
