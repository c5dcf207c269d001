"""Exact duplicates: groups by a 128-bit content hash, bytes compared inside a group.

Only texts whose hash occurs more than once move, as a bitmap tells before the exchange; equal ones collapse before the exchange, so a
group that holds a third of all rows costs one text per task.  Grouping by (hash, text) compares the
bytes: different texts under one hash end in different classes.  Members find their class by a
join whose sides are both laid out anew, which adaptive execution may split at a hot class.

Defined cases: a null text is an empty one.  ``keep`` says whether the smallest or the largest id of
a class stays; a null id loses to any other, and a class that has only null ids keeps one of its rows with
``keep_id`` null.  Rows that repeat both id and text count in ``group_size`` and only one of
them stays.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchframe.llm.common import in_bitmap, only, text_key, texts
from sketchframe.session import write_out


def classes(docs: DataFrame, keep: str = "smallest", content_hash: Callable[[Column], Column] = text_key) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, and its ``key``.

    ``content_hash`` may be weaker; classes stay right since texts are compared.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    chosen = F.min("doc_id") if keep == "smallest" else F.max("doc_id")
    text = F.col("text")
    sha, key = F.sha2(text.cast("binary"), 256), text_key(text)
    base = texts(docs)
    marks = write_out(base.select("doc_id", content_hash(text).alias("h"), sha.alias("text_sha256"), key.alias("key")), "marks")
    repeated = write_out(marks.groupBy("h").count().where("count > 1").select("h"), "repeated")
    hashed = base.select("doc_id", "text", content_hash(text).alias("h")).withColumn("id", F.xxhash64("h"))
    several = in_bitmap(hashed, "id", repeated.select(F.xxhash64("h").alias("id"))).join(repeated, "h", "left_semi")
    members = write_out(several.groupBy("h", "text", "doc_id").agg(F.count("*").alias("rows")), "members")
    found = write_out(members.groupBy("h", "text").agg(chosen.alias("keep_id"), F.sum("rows").alias("group_size")), "classes")
    placed = members.join(found, ["h", "text"]).select(
        "doc_id", "keep_id", "group_size", sha.alias("text_sha256"), key.alias("key"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")
    )
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    alone = marks.join(repeated, "h", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "key"
    )
    return placed.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256", "key").unionByName(alone)


def deduplicate(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs``, all columns, one for each distinct text."""
    found = classes(docs, keep)
    return only(docs, found.groupBy("doc_id", "key").agg(F.count("*").alias("rows"), F.max("kept").alias("kept")))
