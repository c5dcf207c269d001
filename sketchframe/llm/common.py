"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchframe.session import write_out

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text, ...) of a table that may have any other columns; a null text is empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def text_key(text: Column | str = "text") -> Column:
    """128 bits of a text, to find the row of a document again where ids repeat."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def only(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``pairs(doc_id, key, rows, kept)`` keeps, once each.

    ``rows`` tells how often ``docs`` has that id and text.  Rows that a bitmap shows to be kept and single, nearly all, pass
    where they are; the others meet their pair in a join, and repeated ones are grouped.
    """
    concerned = pairs.where("rows > 1 or not kept").select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_mark"), F.col("rows").alias("_rows"), F.col("kept").alias("_kept")
    )
    concerned = write_out(concerned, "concerned")
    tagged = packed(docs)
    tagged = tagged.withColumn("hash", F.xxhash64("mark", "id"))
    tagged = flagged(tagged, "hash", concerned.select(F.xxhash64("_mark", "_id").alias("id")))
    free = tagged.where("not _maybe").select("row")
    same = (F.col("mark") == F.col("_mark")) & F.col("id").eqNullSafe(F.col("_id"))
    met = tagged.where("_maybe").join(concerned, same, "left")
    single = met.where("_mark is null").select("row")
    # repeated rows may differ in other columns, of any type; the one whose text form is least stays
    repeated = met.where("_kept").groupBy("id", "mark").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return free.unionByName(single).unionByName(repeated).select("row.*")


def packed(docs: DataFrame) -> DataFrame:
    """(row, mark, id): every row as one struct, so that no column of it can clash with those of an operator."""
    return docs.select(F.struct("*").alias("row"), text_key().alias("mark"), F.col("doc_id").cast("bigint").alias("id"))


def labelled(labels: DataFrame, column: str, learn: Column) -> DataFrame:
    """(doc_id, label) of the ids to learn from, one row each."""
    wanted = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return wanted.where("doc_id is not null and label in (0, 1)").where(learn).groupBy("doc_id").agg(F.max("label").alias("label"))


def bounded_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, text, label): at most ``per_class`` ids of each label, those with the least hash."""
    chosen = None
    for label in (0, 1):
        some = labels.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    return docs.join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class rows of 12 bytes


def learnable(n: int, out: int) -> tuple[Column, Column]:
    """(held out, may be learned from): whether the id's remainder is ``out``."""
    held = remainder(n) == out
    return held, ~held


BITMAP_BITS = 24


def flagged(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``df`` with ``_maybe``: whether its long may be in ``wanted(id)``; true for all that are, and a share of the others.

    A bitmap of fixed size (2 MB), sent to all tasks, tells; it spares wide rows an exchange that a join
    throws away.  The more ids are wanted, the more other rows are flagged.
    """
    place = F.col("id").bitwiseAND((1 << BITMAP_BITS) - 1)
    pages = wanted.select(F.shiftright(place, 15).alias("_page"), place.bitwiseAND(32767).alias("_bit"))
    pages = pages.groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_map"))  # 2 ** 9 pages of 4 KB
    own = F.col(column).bitwiseAND((1 << BITMAP_BITS) - 1)
    byte = F.substring("_map", F.shiftright(own.bitwiseAND(32767), 3).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    is_set = F.call_function("shiftright", value, own.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    joined = df.join(F.broadcast(pages), F.shiftright(own, 15) == F.col("_page"), "left")
    return joined.withColumn("_maybe", F.coalesce(is_set, F.lit(False))).drop("_page", "_bit", "_map")


def in_bitmap(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` that are flagged: all whose long is in ``wanted(id)``, and some others."""
    return flagged(df, column, wanted).where("_maybe").drop("_maybe")
