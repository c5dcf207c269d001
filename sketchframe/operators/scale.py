"""Column scalers over long tables; implicit zeros count and are never stored.

``fit_*`` returns one row per column that has a stored value, ``scale_*``
applies it.  Fit on train and apply to both splits, or pass the test split to
both calls to refit it.

No fit makes a cell for a zero: minimum, maximum, mean and deviation add the zeros by number, and order statistics
treat them as one value that stands between the negative and the positive ones.  When a scaler is applied, only columns with a
shift turn zeros into other values, so only these unfold over the rows; all others touch their stored cells alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchframe.operators.reshape import to_long
from sketchframe.session import BROADCAST_ROWS, maybe_broadcast, write_out

QUARTILES = (0.25, 0.5, 0.75)
GRID = 200  # steps of the percentiles that bracket a rank
CHUNK = 10_000  # columns that one marker unfolds into


def _with_zero(aggregate: Column, m: int, pick) -> Column:
    """Let zero take part in a min or max when some cell of the column is unstored."""
    return F.when(F.count("v") < m, pick(aggregate, F.lit(0.0))).otherwise(aggregate)


def fit_minmax(df: DataFrame, m: int) -> DataFrame:
    return df.groupBy("f").agg(
        _with_zero(F.min("v"), m, F.least).alias("shift"),
        (_with_zero(F.max("v"), m, F.greatest) - _with_zero(F.min("v"), m, F.least)).alias("spread"),
    )


def fit_standard(df: DataFrame, m: int) -> DataFrame:
    """Mean and population deviation, merging stored values with m - count zeros."""
    stored = df.groupBy("f").agg(
        F.count("v").alias("c"), F.avg("v").alias("mu"), F.var_pop("v").alias("s2")
    )
    mean = F.col("mu") * F.col("c") / F.lit(float(m))
    off = F.col("mu") - F.col("mean")
    total = F.col("c") * (F.col("s2") + off * off) + (F.lit(m) - F.col("c")) * F.col("mean") * F.col("mean")
    return stored.withColumn("mean", mean).select(
        "f", F.col("mean").alias("shift"), F.sqrt(total / F.lit(float(m))).alias("spread")
    )


def fit_maxabs(df: DataFrame) -> DataFrame:
    return df.groupBy("f").agg(F.lit(0.0).alias("shift"), F.max(F.abs("v")).alias("spread"))


def _ranks(m: int) -> list[tuple[int, int, float]]:
    """For every quartile of ``m`` values: the ranks, from 1, of the values beside it, and the weight of the upper one."""
    places = [(m - 1) * q for q in QUARTILES]
    return [(int(p) + 1, min(int(p) + 2, m), p - int(p)) for p in places]


def _wanted(df: DataFrame, m: int, accuracy: int) -> DataFrame:
    """(f, q, upper, fraction, zero, r, low, high): the six values that the quartiles of a column need.

    A rank is among the column's zeros, and then the value is known, or becomes the rank ``r`` among its stored values.  These are
    bracketed by two points of a grid of approximate percentiles, with room for their errors on either side.
    """
    pad = 1 + math.ceil(2 * GRID / accuracy)
    grid = F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], accuracy).alias("grid")
    below = F.sum(F.when(F.col("v") < 0, 1).otherwise(0)).alias("below")
    columns = df.where("v <> 0").groupBy("f").agg(F.count("*").alias("stored"), below, grid)
    each = [
        F.struct(F.lit(q).alias("q"), F.lit(bool(side)).alias("upper"), F.lit(pair[2]).alias("fraction"), F.lit(pair[side]).cast("bigint").alias("rank"))
        for q, pair in enumerate(_ranks(m))
        for side in (0, 1)
    ]
    zeros = F.lit(m) - F.col("stored")
    places = columns.select("f", "stored", "below", "grid", zeros.alias("zeros"), F.inline(F.array(*each)))
    zero = (F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("zeros"))
    rank = F.when(F.col("rank") <= F.col("below"), F.col("rank")).otherwise(F.col("rank") - F.col("zeros"))
    at = F.col("r") * GRID / F.col("stored")
    point = lambda i: F.col("grid")[F.least(F.greatest(i, F.lit(0)), F.lit(GRID)).cast("int")]
    ranked = places.withColumn("zero", zero).withColumn("r", F.when(~zero, rank))
    return ranked.select("f", "q", "upper", "fraction", "zero", "r", point(F.floor(at) - pad).alias("low"), point(F.ceil(at) + pad).alias("high"))


def fit_robust(df: DataFrame, rows: DataFrame | None, m: int, n: int, accuracy: int = 10_000) -> DataFrame:
    """Median and interquartile range, exact, over the stored cells and the number of zeros; ``rows`` and ``n`` are not read.

    Only columns with a quartile among their stored values are counted by value, and of these only the distinct values
    inside a bracket are ranked, offset by an exact count of what lies below it.  No task sorts a column.
    """
    wanted = write_out(_wanted(df, m, accuracy), "quartiles")
    open_ = write_out(wanted.where("not zero").select("f", "r", "low", "high").distinct(), "ranks")
    bound = open_.count()
    counted = df.where("v <> 0").join(maybe_broadcast(open_.select("f").distinct(), bound), "f", "left_semi").groupBy("f", "v").agg(F.count("*").alias("c"))
    near = counted.join(maybe_broadcast(open_, bound), "f")
    below = near.groupBy("f", "r").agg(F.sum(F.when(F.col("v") < F.col("low"), F.col("c")).otherwise(0)).alias("base"))
    inside = near.where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    running = F.sum("c").over(Window.partitionBy("f", "r").orderBy("v"))
    ranked = inside.select("f", "r", "v", running.alias("upto")).join(_beside(below, bound), ["f", "r"])
    found = ranked.where(F.col("base") + F.col("upto") >= F.col("r")).groupBy("f", "r").agg(F.min("v").alias("v"))
    value = F.when(F.col("zero"), F.lit(0.0)).otherwise(F.col("v"))
    known = wanted.join(_beside(found, bound), ["f", "r"], "left").select("f", "q", "upper", "fraction", value.alias("v"))
    lower, upper = F.max(F.when(~F.col("upper"), F.col("v"))), F.max(F.when(F.col("upper"), F.col("v")))
    quartile = known.groupBy("f", "q").agg((lower + (upper - lower) * F.first("fraction")).alias("x"))
    by = [F.max(F.when(F.col("q") == q, F.col("x"))) for q in range(len(QUARTILES))]
    return quartile.groupBy("f").agg(by[1].alias("shift"), (by[2] - by[0]).alias("spread"))


def _beside(fitted: DataFrame, rows: int) -> DataFrame:
    """A fitted table for a join: sent to all tasks if provably small, else stored.

    A stored table is laid out for the join by an exchange of its own; only then may adaptive execution split the other
    side at a hot key, which it does not where an aggregate is laid out by that key already.
    """
    return maybe_broadcast(fitted, rows) if rows <= BROADCAST_ROWS else write_out(fitted, "fitted")


def _scaled(v: Column) -> Column:
    width = F.when(F.coalesce("spread", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("spread"))
    return (v - F.coalesce("shift", F.lit(0.0))) / width


def _apply(df: DataFrame, fitted: DataFrame, n: int, rows: DataFrame | None = None) -> DataFrame:
    """Scale the stored cells, and over ``rows`` the zeros of columns with a shift.

    Of these columns only the stored cells and a marker per row and ``CHUNK`` columns are exchanged; a marker unfolds into
    its columns' zeros where the row's cells already are.
    """
    if rows is not None:
        fitted = write_out(fitted, "fitted")
        shifted = fitted.where("shift <> 0")
        count = shifted.count()
    joined = df.join(_beside(fitted, n), "f", "left")
    if rows is None or not count:
        return to_long(joined.select("row_id", "f", _scaled(F.col("v")).alias("v")))
    still = joined.where(F.coalesce("shift", F.lit(0.0)) == 0).select("row_id", "f", _scaled(F.col("v")).alias("v"))
    moved = joined.where("shift <> 0").select("row_id", F.lit(-1).alias("chunk"), F.struct(F.col("f"), _scaled(F.col("v")).alias("v")).alias("cell"))
    chunks = 1 + count // CHUNK
    zeros = F.collect_list(F.struct(F.col("f"), _scaled(F.lit(0.0)).alias("v"))).alias("zeros")  # about CHUNK columns
    table = write_out(shifted.groupBy(F.pmod(F.hash("f"), F.lit(chunks)).alias("chunk")).agg(zeros), "shifted")
    marker = rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(None).cast(moved.schema["cell"].dataType).alias("cell"))
    gathered = moved.unionByName(marker).repartition("row_id").join(maybe_broadcast(table, count), "chunk", "left")
    stored = F.col("chunk") < 0
    cells = gathered.select("row_id", stored.alias("stored"), F.explode(F.when(stored, F.array("cell")).otherwise(F.col("zeros"))).alias("cell"))
    chosen = cells.groupBy("row_id", F.col("cell.f").alias("f")).agg(F.max(F.struct("stored", "cell.v")).alias("best"))
    return to_long(still.unionByName(chosen.select("row_id", "f", F.col("best.v").alias("v"))))


def scale_minmax(df: DataFrame, rows: DataFrame, m: int, n: int, fitted: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min) per column; a constant column becomes 0."""
    return _apply(df, fit_minmax(df, m) if fitted is None else fitted, n, rows)


def scale_standard(df: DataFrame, rows: DataFrame, m: int, n: int, fitted: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation per column; zero deviation divides by 1."""
    return _apply(df, fit_standard(df, m) if fitted is None else fitted, n, rows)


def scale_robust(df: DataFrame, rows: DataFrame, m: int, n: int, fitted: DataFrame | None = None) -> DataFrame:
    """(x - median) / interquartile range per column."""
    return _apply(df, fit_robust(df, rows, m, n) if fitted is None else fitted, n, rows)


def scale_maxabs(df: DataFrame, n: int, fitted: DataFrame | None = None) -> DataFrame:
    """x / max|x| per column.  Zero stays zero, so only stored cells are touched."""
    return _apply(df, fit_maxabs(df) if fitted is None else fitted, n)


def scale_normalize(df: DataFrame) -> DataFrame:
    """Each row to unit length; a zero row has no stored cell and stays as it is."""
    norms = write_out(df.groupBy("row_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")), "norms")
    return df.join(norms, "row_id").select("row_id", "f", (F.col("v") / F.col("norm")).alias("v"))
