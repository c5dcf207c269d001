"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None if the two frames hold the same rows, else what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} rows against {len(sql_frame)}"
    if spark_frame.empty:
        return None
    left, right = canonical(spark_frame), canonical(sql_frame)
    kinds = {c: (left[c].dtype, right[c].dtype) for c in left.columns if left[c].dtype.kind != right[c].dtype.kind}
    if kinds:
        return f"types {kinds}"
    bad = [c for c in left.columns if not (left[c].to_numpy() == right[c].to_numpy()).all()]
    if not bad:
        return None
    first = (left[bad[0]].to_numpy() != right[bad[0]].to_numpy()).nonzero()[0]
    return f"{len(first)} values of {bad}: {left.iloc[first[0]].to_dict()} against {right.iloc[first[0]].to_dict()}"


def main(root: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from sketchframe.queries import ORACLES, QUERIES
    from sketchframe.session import build_session

    spark, con = build_session("8"), connect(root)
    failures = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            got = QUERIES[name](spark, root).toPandas()
            took = time.time() - start
            start = time.time()
            problem = "no SQL" if name not in ORACLES else difference(got, con.execute(ORACLES[name]).df())
            sql = time.time() - start
        except Exception as error:  # report and go on with the next query
            took, sql, got, problem = time.time() - start, 0.0, [], str(error)[:1500]
        failures += problem not in (None, "no SQL")
        print(f"{name:26s} {len(got):9d} rows {took:6.2f}s sql {sql:6.2f}s {problem or 'ok'}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
