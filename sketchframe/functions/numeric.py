"""Scalar column expressions of the linear models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def approx_sigmoid(z, kind: str = "linear"):
    """Polynomial stand-ins for the logistic curve, of a Column or a numpy array.

    ``segment`` keeps ``z`` strictly inside (-0.5, 0.5) and gives 0 elsewhere;
    it is not centred on one half.
    """
    # Linear 0.25 z + 0.5; cube 0.5 + 0.197 z - 0.004 z^3.
    if kind == "linear":
        return z * 0.25 + 0.5
    if kind == "cube":
        return z * 0.197 + 0.5 - z * z * z * 0.004
    if kind == "segment":
        inside = (z > -0.5) & (z < 0.5)
        return F.when(inside, z).otherwise(0.0) if isinstance(z, Column) else np.where(inside, z, 0.0)
    raise ValueError(f"unknown sigmoid approximation {kind!r}")


def threshold(p: Column, cut: float = 0.5, negative: int = -1) -> Column:
    """1 from ``cut`` on, else ``negative``; also for NaN, which Spark sorts above all numbers."""
    return F.when((p >= F.lit(cut)) & ~F.isnan(p), F.lit(1)).otherwise(F.lit(negative)).cast("int")


def taylor_term(z, y, batch_size):
    """One row's share of the second-order expansion of the log loss; Columns or arrays."""
    return (z * -0.5 + y * z - z * z * 0.125) * (-1.0 / batch_size) - math.log(0.5)
