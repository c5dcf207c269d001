"""Row alignment and column stacking of two parties' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unmatched_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row ids only one side has: (row_id, side)."""
    left = a.select("row_id").withColumn("in_a", F.lit(1))
    right = b.select("row_id").withColumn("in_b", F.lit(1))
    both = left.join(right, "row_id", "full_outer")
    side = F.when(F.col("in_b").isNull(), F.lit("a")).otherwise(F.lit("b"))
    return both.where(F.col("in_a").isNull() | F.col("in_b").isNull()).select("row_id", side.alias("side"))


def align_parties(a: DataFrame, b: DataFrame, strict: bool = True) -> DataFrame:
    """Inner join of two tables that hold one row per ``row_id``.

    With ``strict`` the row sets must be equal, as positional alignment implies.
    """
    if strict and not unmatched_rows(a, b).isEmpty():
        raise ValueError("the two parties hold different rows")
    return a.join(b, "row_id")


def hstack(a: DataFrame, b: DataFrame, width_a: int, column: str = "f") -> DataFrame:
    """B's columns after A's."""
    return a.unionByName(b.withColumn(column, F.col(column) + F.lit(width_a).cast("bigint")))
