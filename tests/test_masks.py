"""Keyed masks: never in a plan or a log, and the same in every run of a task."""

from __future__ import annotations

import os
import subprocess
import sys

from sketchframe.operators import shares

SECRET = "correct horse battery"


def test_masks_are_uniform_and_belong_to_cell_party_and_secret(spark, cells):
    x = cells({r: {f: 1.0 for f in range(20)} for r in range(200)})

    def made(secret, party, df=x):
        return {(r["row_id"], r["f"]): r["m"] for r in df.select("row_id", "f", shares.keyed_masks(spark, secret, party)("row_id", "f").alias("m")).collect()}

    one = made(SECRET, "A")
    assert one == made(SECRET, "A", x.repartition(7))
    assert all(0 <= m < shares.RING for m in one.values()) and len(set(one.values())) == 4000
    assert abs(sum(one.values()) / 4000 / shares.RING - 0.5) < 0.03
    for other in (made(SECRET, "B"), made("another", "A")):
        assert not set(other.values()) & set(one.values())


def test_null_ids_have_a_mask(spark):
    df = spark.createDataFrame([(None, 0), (0, 0)], "row_id bigint, f bigint")
    got = [r[0] for r in df.select(shares.keyed_masks(spark, SECRET, "A")("row_id", "f")).collect()]
    assert None not in got and len(set(got)) == 2


def test_the_plan_does_not_show_the_secret(cells):
    a, b = shares.share_split(cells({0: {0: 1.5}}), secret=SECRET)
    for df in (a, b):
        assert SECRET not in df._jdf.queryExecution().toString()
    assert shares.reconstruct(a, b).first()["v"] == 1.5


RUN = """
import sys
from pyspark.sql import SparkSession
from sketchframe.operators import shares
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
         .config("spark.eventLog.compress", "false").config("spark.eventLog.dir", "file://" + sys.argv[1]).getOrCreate())
x = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "row_id bigint, f bigint, v double")
for df in shares.share_split(x, secret=sys.argv[2]):
    df.collect()
spark.stop()
"""


def test_the_event_log_does_not_show_the_secret(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", RUN, str(tmp_path), SECRET], check=True, cwd=root, capture_output=True, timeout=120)
    logs = [p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()]
    assert any(b"SparkListenerSQLExecutionStart" in log for log in logs)
    assert not any(SECRET.encode() in log for log in logs)
