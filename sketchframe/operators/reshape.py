"""Projections, filters and reshaping of long feature tables.

A feature table is ``X(row_id, f, v)`` with one row per stored non-zero.  The
companion ``rows(row_id)`` lists every row, so that empty ones survive.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchframe.functions.hashing import hash64, stream_key
from sketchframe.session import maybe_broadcast

CELL = ["row_id", "f", "v"]


def weighted_set(df: DataFrame, row: Column | str, feature: Column | str, weight: Column | str) -> DataFrame:
    """Sparse table from (row, feature, weight) triples; duplicates add up.

    The grouping pre-aggregates on the map side, so a pair repeated in a large
    share of the input costs one record per task.
    """
    def as_column(c):
        return F.col(c) if isinstance(c, str) else c

    cells = df.select(
        as_column(row).cast("bigint").alias("row_id"),
        as_column(feature).cast("bigint").alias("f"),
        as_column(weight).cast("double").alias("v"),
    )
    return cells.groupBy("row_id", "f").agg(F.sum("v").alias("v")).where(F.col("v") != 0)


def select_first(rows: DataFrame, m_selected: int, seed: int = 1) -> Column:
    """Row filter that keeps exactly ``m_selected`` rows of lowest hash.

    The hashes are uniform, so a histogram over their top 16 bits finds the
    bucket that holds the cut, and only that bucket (about 1/65536 of the rows)
    is ranked.  The answer is a pair (hash, row_id) compared in place: the
    feature table needs neither a join nor a shuffle.
    """
    key = stream_key(seed, "row")
    order = F.expr(hash64(key, "row_id"))
    hashed = rows.select("row_id", order.alias("h")).withColumn("bucket", F.shiftright("h", 48))
    counts = hashed.groupBy("bucket").count()
    running = F.sum("count").over(Window.orderBy("bucket"))  # at most 65,536 rows
    cut = (
        counts.withColumn("running", running)
        .where((F.col("running") >= m_selected) & (F.col("running") - F.col("count") < m_selected))
        .select(F.struct("bucket", (F.lit(m_selected) - F.col("running") + F.col("count")).alias("need")))
    ).first()
    if cut is None:
        raise ValueError(f"cannot select {m_selected} rows: the table has fewer")
    bucket, need = cut[0]
    edge = (
        hashed.where(F.col("bucket") == bucket)
        .withColumn("rank", F.row_number().over(Window.orderBy("h", "row_id")))
        .where(F.col("rank") == need)
        .select("h", "row_id")
    ).first()
    return (order < edge.h) | ((order == edge.h) & (F.col("row_id") <= edge.row_id))


def sample_rows(df: DataFrame, rows: DataFrame, m_selected: int, seed: int = 1, m: int | None = None) -> DataFrame:
    """Exactly ``m_selected`` rows without replacement; ``m`` is an optional check."""
    if m is not None and rows.count() != m:
        raise ValueError(f"expected exactly {m} rows")
    if m_selected < 0:
        raise ValueError("m_selected must not be negative")
    if m_selected == 0:
        return df.where(F.lit(False))
    return df.where(select_first(rows, m_selected, seed))


def fit_width(df: DataFrame, n: int, on_overflow: str = "error") -> DataFrame:
    """Force the width to ``n``.  Growing needs no work: missing cells are zero."""
    if on_overflow == "truncate":
        return df.where(F.col("f") < n)
    if on_overflow != "error":
        raise ValueError("on_overflow must be 'error' or 'truncate'")
    message = F.concat(F.lit(f"feature id beyond width {n}: "), F.col("f").cast("string"))
    checked = F.when(F.col("f") < n, F.col("f")).otherwise(F.raise_error(message).cast("bigint"))
    return df.withColumn("f", checked)


def split_width(n: int, portion: float) -> int:
    return math.floor(n * portion)


# Codes of the column portion given to the first party.
PORTION_CODES = {19: 0.1, 28: 0.2, 37: 0.3, 46: 0.4, 55: 0.5}


def portion_from_code(code: int) -> float:
    """0.3 for 37, as in three columns to seven."""
    return PORTION_CODES[code]


def vertical_split_at(df: DataFrame, n1: int) -> tuple[DataFrame, DataFrame]:
    """Columns below ``n1``, and the rest numbered from 0 again."""
    first = df.where(F.col("f") < n1)
    second = df.where(F.col("f") >= n1).withColumn("f", F.col("f") - F.lit(n1).cast("bigint"))
    return first, second


def vertical_split(df: DataFrame, n: int, portion: float) -> tuple[DataFrame, DataFrame]:
    return vertical_split_at(df, split_width(n, portion))


def separate_signs(train: DataFrame, test: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """Give negative values their own columns if there are any in either split.

    Returns both tables and the width: ``n`` when nothing is negative, else 2n.
    One column is read ahead to learn which of the two plans to build.
    """
    low = train.select("v").unionByName(test.select("v")).agg(F.min("v")).first()[0]
    if low is None or low >= 0:
        return train, test, n
    return signs_apart(train), signs_apart(test), 2 * n


def signs_apart(df: DataFrame) -> DataFrame:
    """v >= 0 goes to column 2f, v < 0 to column 2f+1 as -v."""
    column = F.col("f") * 2 + (F.col("v") < 0).cast("bigint")
    return df.select("row_id", column.alias("f"), F.abs("v").alias("v"))


def positive_part(df: DataFrame) -> DataFrame:
    return df.where(F.col("v") > 0)


def add_bias(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Column 0 becomes all ones; every other column moves up by one."""
    ones = rows.select("row_id", F.lit(0).cast("bigint").alias("f"), F.lit(1.0).alias("v"))
    return df.select("row_id", (F.col("f") + F.lit(1).cast("bigint")).alias("f"), "v").unionByName(ones)


def transpose(df: DataFrame) -> DataFrame:
    return df.select(F.col("f").alias("row_id"), F.col("row_id").alias("f"), "v")


def head_rows(df: DataFrame, rows: DataFrame, length: int = 100) -> DataFrame:
    """Cells of the first ``length`` rows; a threshold, so no join on the cells."""
    last = rows.select("row_id").orderBy("row_id").limit(length).agg(F.max("row_id"))
    return df.where(F.col("row_id") <= last.scalar())


def to_dense(df: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Every one of the m * n cells, zeros included.

    Only the stored cells and one marker per row are shuffled.  The marker
    unfolds into the row's n zeros where the row's cells already are, and a
    row's group has at most n members.
    """
    marker = rows.selectExpr("row_id", "-1L as f", "0.0D as v")
    gathered = df.select("row_id", "f", "v").unionByName(marker).repartition("row_id")
    cells = gathered.selectExpr("row_id", f"explode(if(f < 0, sequence(0L, {n - 1}L), array(f))) as f", "v")
    return cells.groupBy("row_id", "f").agg(F.sum("v").alias("v"))


def to_long(df: DataFrame) -> DataFrame:
    return df.where(F.col("v") != 0)


def binarize_labels(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """If -1 occurs in train, every label other than 1 becomes 0 in both splits."""
    signed = train.agg(F.coalesce(F.max((F.col("label") == -1).cast("int")), F.lit(0))).scalar() == 1

    def remap(y: DataFrame) -> DataFrame:
        binary = (F.col("label") == 1).cast("int")
        return y.withColumn("label", F.when(signed, binary).otherwise(F.col("label")))

    return remap(train), remap(test)


def ovr_labels(y: DataFrame) -> DataFrame:
    """One binary target per class: (class, row_id, label)."""
    classes = y.agg(F.array_sort(F.collect_set("label"))).scalar()
    fanned = y.select("row_id", "label", F.explode(classes).alias("class"))
    return fanned.select("class", "row_id", (F.col("label") == F.col("class")).cast("int").alias("label"))


def cast_inputs(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        x.withColumn("v", F.col("v").cast("float")),
        y.withColumn("label", F.col("label").cast("int")),
    )


def row_index(df: DataFrame, by: str = "row_id", tie: str | None = None, buckets: int | None = None) -> DataFrame:
    """Add ``idx``: the contiguous 0-based position in ``by`` order.

    Range buckets come from approximate quantiles, their offsets from a count
    per bucket, and only the rows of one bucket are ranked together.  No task
    sees the whole table, and the bucket edges are literals, so a recomputed
    task gives the same numbers.
    """
    spark = df.sparkSession
    parts = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.withColumn("_by", F.col(by).cast("double"))
    probs = [i / parts for i in range(1, parts)]
    edges = sorted(set(keyed.approxQuantile("_by", probs, 1.0 / (4 * parts)))) or [0.0]
    splits = [-float("inf"), *edges, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_by", outputCol="_bucket")
    placed = cut.transform(keyed).drop("_by")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_bucket")
        .count()
        .select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    )  # one row per bucket
    order = [by] if tie is None else [by, tie]
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    ranked = placed.withColumn("_rank", within)
    joined = ranked.join(maybe_broadcast(offsets, len(splits)), "_bucket")
    return joined.withColumn("idx", (F.col("_base") + F.col("_rank")).cast("bigint")).drop("_bucket", "_base", "_rank")


def batch_rows(rows: DataFrame, batch_size: int) -> DataFrame:
    """Consecutive batches in row order: (row_id, batch)."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    numbered = row_index(rows.select("row_id"))
    return numbered.select("row_id", F.expr(f"idx div {int(batch_size)}").cast("bigint").alias("batch"))


def batch_sizes(batches: DataFrame) -> DataFrame:
    return batches.groupBy("batch").agg(F.count("*").alias("size"))


def shuffle_batches(batches: DataFrame, seed: int = 1, epoch: int = 1) -> DataFrame:
    """Whole batches in a random but repeatable order: (batch, position).

    Apply it to several aligned tables by joining each on ``batch``.
    """
    key = stream_key(seed, "batch")
    ids = batches.select("batch").distinct().withColumn("_h", F.expr(hash64(key, "batch", str(epoch))))
    return row_index(ids, by="_h", tie="batch").select("batch", F.col("idx").alias("position"))
