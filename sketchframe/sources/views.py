"""Feature views over relational tables, one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchframe.operators.reshape import weighted_set


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


# Lines that a task joins with their orders and groups.
LINES_PER_TASK = 250_000


def cust_part(spark: SparkSession, root: str) -> DataFrame:
    """Customers as weighted sets of parts, weighted by quantity bought.

    Lines are dealt out in parts whose number grows with them, so what a task sorts and groups does not.
    """
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_PER_TASK))
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return weighted_set(lines.repartition(parts, "l_orderkey").join(orders, "l_orderkey"), "o_custkey", "l_partkey", "l_quantity")


def cust_rows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(F.col("c_custkey").alias("row_id"))


def part_count(spark: SparkSession, root: str) -> int:
    """Width of ``cust_part``: part keys count from 0."""
    return table(spark, root, "part").agg(F.max("p_partkey")).first()[0] + 1


def emb(spark: SparkSession, root: str) -> DataFrame:
    """Embedding components as signed dense features."""
    wide = table(spark, root, "embeddings")
    long = wide.select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("f", "v"))
    cells = long.select("row_id", F.col("f").cast("bigint").alias("f"), F.col("v").cast("double").alias("v"))
    return cells.where(F.col("v") != 0)


def emb_labels(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("row_id"), "label")


def emb_width(spark: SparkSession, root: str) -> int:
    return table(spark, root, "embeddings").agg(F.max(F.size("embedding"))).first()[0]


# Terms are numbered by 60 bits of their MD5, so no global dictionary is needed.
TERM_BITS = 60


# Letters and other characters of text whose terms meet in one task.
CHARS_PER_TASK = 3_000_000


def doc_terms(spark: SparkSession, root: str, labelled: bool = False) -> DataFrame:
    """Documents as sets of lower-case words (runs of letters), weighted by count.

    Words are numbered and counted within the row that holds them, so no task keeps a table of the terms of all that it reads.
    Rows of one id meet in one exchange of numbers, into partitions that grow in number with the text.
    """
    docs = table(spark, root, "documents").select("doc_id", "text")
    if labelled:
        docs = docs.join(table(spark, root, "labels").select("doc_id"), "doc_id", "left_semi")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHARS_PER_TASK))

    def term_id(term: Column) -> Column:
        return F.conv(F.substring(F.md5(term.cast("binary")), 1, TERM_BITS // 4), 16, 10).cast("bigint")

    words = F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: w != "")
    ids = docs.select("doc_id", F.sort_array(F.transform(words, term_id)).alias("ids"))
    places = F.when(F.size("ids") > 0, F.sequence(F.lit(0), F.size("ids") - 1))
    first = F.filter(places, lambda i: (i == 0) | (F.get("ids", i) != F.get("ids", i - 1)))  # of equal numbers, which stand together
    runs = ids.select("doc_id", "ids", first.alias("first"))

    def entry(i: Column, k: Column) -> Column:
        after = F.coalesce(F.get("first", k + 1), F.size("ids"))
        return F.struct(F.get("ids", i).alias("f"), (after - i).alias("n"))

    terms = runs.select("doc_id", F.inline(F.transform("first", entry)))
    return weighted_set(terms.repartition(parts, "doc_id", "f"), "doc_id", "f", "n")


def doc_rows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select(F.col("doc_id").alias("row_id")).distinct()


def doc_labels(spark: SparkSession, root: str) -> DataFrame:
    labels = table(spark, root, "labels")
    return labels.select(F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("label"))


def event_types(spark: SparkSession, root: str) -> list[str]:
    """The event types of the table in alphabetical order: a column each."""
    return [r[0] for r in table(spark, root, "events").select("event_type").where("event_type is not null").distinct().orderBy("event_type").collect()]


def event_mix(spark: SparkSession, root: str, types: list[str]) -> DataFrame:
    """Users by event type, summing the value; a type that ``types`` lacks is an error."""
    events = table(spark, root, "events").select("user_id", "event_type", "value").where("event_type is not null")
    column = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("event_type")) - 1
    known = F.when(column >= 0, column).otherwise(F.raise_error(F.concat(F.lit("unknown event type "), "event_type")).cast("bigint"))
    return weighted_set(events, F.col("user_id"), known, F.col("value"))


def event_rows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select(F.col("user_id").alias("row_id")).distinct()
