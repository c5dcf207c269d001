"""svmlight text (plain, .bz2, .gz): ``label [qid:q] index:value ... [# note]``."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchframe.session import maybe_broadcast, write_out


class SparseData(NamedTuple):
    """Cells X(row_id, f, v), labels y(row_id, label), rows(row_id) and the width."""

    x: DataFrame
    y: DataFrame
    rows: DataFrame
    n: int


def numbered_lines(spark: SparkSession, path: str | list[str], keep: Column | None = None) -> DataFrame:
    """(row_id, value): lines numbered from 0 in file order.

    The text is read once and stored with its file, block and place in the task, as the task saw them; a
    later evaluation under another parallelism would cut the files elsewhere.  Each block then gets the
    total of the blocks before it, and every number comes from the stored lines.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    if keep is not None:
        lines = lines.where(keep)
    tagged = write_out(lines.withColumn("_local", F.monotonically_increasing_id()), "lines")
    counted = tagged.groupBy("_file", "_block").agg(F.min("_local").alias("first"), F.count("*").alias("size"))
    blocks = write_out(counted, "blocks")
    before = F.sum("size").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    shift = (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_shift")
    offsets = maybe_broadcast(blocks.select("_file", "_block", shift), blocks.count())
    return tagged.join(offsets, ["_file", "_block"]).select((F.col("_local") + F.col("_shift")).alias("row_id"), "value")


def read_svmlight(
    spark: SparkSession, path: str | list[str], n: int | None = None, zero_based: bool | str = "auto"
) -> SparseData:
    """Read svmlight text.  Values are rounded to float32, labels cast to int.

    With ``zero_based='auto'`` indices count from 0 if index 0 occurs, else
    from 1.  Without ``n`` the width is the largest index seen.  Both answers
    come from one pass over the stored lines.  An index beyond a given ``n`` raises an error.
    """
    body = F.trim(F.regexp_replace("value", "#.*", ""))
    lines = numbered_lines(spark, path, keep=body != "")
    tokens = F.split(F.regexp_replace(body, "\\s+", " "), " ")
    parsed = lines.select("row_id", tokens.alias("t"))
    y = parsed.select("row_id", F.col("t")[0].cast("double").cast("int").alias("label"))
    pairs = parsed.select("row_id", F.explode(F.slice("t", F.lit(2), F.size("t"))).alias("p")).where(~F.col("p").startswith("qid:"))
    cells = pairs.select(
        "row_id",
        F.split_part("p", F.lit(":"), F.lit(1)).cast("bigint").alias("f"),
        F.split_part("p", F.lit(":"), F.lit(2)).cast("float").cast("double").alias("v"),
    )
    low, high = cells.agg(F.min("f"), F.max("f")).first()
    shift = 0 if zero_based is True or (zero_based == "auto" and low == 0) else 1
    if n is None:
        n = 0 if high is None else high + 1 - shift
    if high is not None and not (low >= shift and high - shift < n):
        raise ValueError(f"indices {low} to {high} do not fit a width of {n}")
    x = cells.withColumn("f", F.col("f") - F.lit(shift).cast("bigint")).where(F.col("v") != 0)
    return SparseData(x, y, y.select("row_id"), n)


def write_svmlight(lines: DataFrame, path: str, compression: str | None = None) -> None:
    """Write rows of (label, values ARRAY<FLOAT>) as one-based svmlight text."""
    items = F.transform("values", lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"), v.cast("string")))
    text = lines.select(F.concat_ws(" ", F.col("label").cast("string"), items).alias("value"))
    writer = text.write.mode("errorifexists")
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)
