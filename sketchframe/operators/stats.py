"""Aggregates and reports.  Each is one grouped pass with map-side partials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix_min(df: DataFrame, m: int, n: int) -> DataFrame:
    """Minimum over all m * n cells, implicit zeros included."""
    low = F.coalesce(F.min("v"), F.lit(0.0))
    return df.agg(F.when(F.count("v") < m * n, F.least(low, F.lit(0.0))).otherwise(low).alias("min_v"))


def variance_of(m: int, n: int) -> Column:
    cells = F.lit(float(m) * float(n))
    mean = F.coalesce(F.sum("v"), F.lit(0.0)) / cells
    return F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)) / cells - mean * mean


def matrix_variance(df: DataFrame, m: int, n: int) -> DataFrame:
    """Mean of squares minus square of the mean, over all m * n cells."""
    return df.agg(variance_of(m, n).alias("variance"))


def class_summary(train: DataFrame, test: DataFrame, class_num: int | None = None) -> DataFrame:
    """(label, train_rows, test_rows); optionally check the number of train classes."""
    tagged = train.select("label", F.lit(1).alias("a")).unionByName(test.select("label", F.lit(0).alias("a")))
    summary = tagged.groupBy("label").agg(
        F.sum("a").cast("bigint").alias("train_rows"),
        F.sum(1 - F.col("a")).cast("bigint").alias("test_rows"),
    )
    if class_num is not None:
        found = summary.where(F.col("train_rows") > 0).count()
        if found != class_num:
            raise ValueError(f"train holds {found} classes, expected {class_num}")
    return summary


def shape_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, n_cols) of sample or sketch tables keyed by (row_id, j)."""
    parts = [
        df.agg(F.countDistinct("row_id").alias("n_rows"), F.countDistinct("j").alias("n_cols")).select(
            F.lit(name).alias("name"), "n_rows", "n_cols"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def zero_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, empty_rows, empty_samples); a sample of -1 or 0 is empty."""
    empty = F.col("s").isin(-1, 0)
    parts = [
        df.agg(
            F.count_if((F.col("j") == 0) & empty).alias("empty_rows"),
            F.count_if(empty).alias("empty_samples"),
        ).select(F.lit(name).alias("name"), "empty_rows", "empty_samples")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def resolve_gamma(
    df: DataFrame,
    m: int,
    n: int,
    gamma: float = 0.0,
    mode: str = "scale",
    normalization: bool = False,
) -> DataFrame:
    """(base, gamma): an explicit value wins, else 1/n, divided by the variance for 'scale'.

    With sign normalization ``n`` is the original width and the base is 1/(2n).
    The vertical layout uses the same whole-matrix value for both parties.
    """
    if mode not in ("auto", "scale"):
        raise ValueError("mode must be 'auto' or 'scale'")
    width = 2 * n if normalization else n
    base = F.lit(1.0 / width)
    if gamma != 0:
        chosen = F.lit(float(gamma))
    elif mode == "auto":
        chosen = base
    else:
        chosen = base / F.nullif(variance_of(m, width), F.lit(0.0))
    return df.agg(F.count("v").alias("_n"), chosen.alias("gamma")).select(base.alias("base"), "gamma")


def accuracy(df: DataFrame, percent: bool = False) -> DataFrame:
    """Share of rows whose ``prediction`` equals ``label``."""
    hit = (F.col("prediction") == F.col("label")).cast("double")
    share = F.avg(hit) * F.lit(100.0) if percent else F.avg(hit)
    return df.agg(share.alias("accuracy"), F.count("*").alias("n_rows"))


def best_epoch(metrics: DataFrame) -> DataFrame:
    """The row of highest accuracy; the earliest epoch on ties.  NaN loses to any number."""
    others = [c for c in metrics.columns if c not in ("accuracy", "epoch")]
    worth = F.when(~F.isnan("accuracy"), F.col("accuracy")).alias("_worth")
    best = F.max(F.struct(worth, "accuracy", (-F.col("epoch")).alias("_back"), *others)).alias("b")
    fields = [F.col("b.accuracy"), (-F.col("b._back")).alias("epoch"), *[F.col(f"b.{c}") for c in others]]
    return metrics.agg(best).select(*fields).select(*metrics.columns)
