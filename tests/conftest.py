from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sketchframe.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cells(spark):
    """Build X(row_id, f, v) from {row: {f: v}}."""

    def build(rows: dict[int, dict[int, float]]):
        data = [(r, f, float(v)) for r, fv in rows.items() for f, v in fv.items()]
        return spark.createDataFrame(data, "row_id bigint, f bigint, v double")

    return build


@pytest.fixture(scope="session")
def rows_of(spark):
    def build(ids):
        return spark.createDataFrame([(int(i),) for i in ids], "row_id bigint")

    return build


def as_dict(df, value="v", column="f"):
    """{(row, column): value} of a long table."""
    return {(r["row_id"], r[column]): r[value] for r in df.collect()}
