"""Settings and bounds shared by the operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its row count is known to stay below this.
BROADCAST_ROWS = 500_000
# Narrow rows that are worth a task, and how many tasks a table gets however small it is.
PART_ROWS, LEAST_PARTS = 20_000, 8


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sketchframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Where a session on one machine names none, as in tests, a temporary one is made; on a cluster
    that is an error, since executors would not see each other's files.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sketchframe-"))
        root = context.getCheckpointDir()
    return root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nobody else writes to."""
    return os.path.join(shared_dir(spark), "sketchframe", f"{label}-{uuid.uuid4().hex}")


def write_out(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parts(df: DataFrame, row_bound: int) -> DataFrame:
    """``df``, of at most ``row_bound`` narrow rows, in no more parts than these ask for.

    The number of parts grows with the bound; only where the session deals out a small table to more tasks than that, some become one.
    """
    return df.coalesce(max(LEAST_PARTS, -(-row_bound // PART_ROWS)))


def maybe_broadcast(df: DataFrame, row_bound: int | None) -> DataFrame:
    """Broadcast hint only for a proven row bound; otherwise a shuffled join."""
    if row_bound is not None and row_bound <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df
