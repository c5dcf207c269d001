"""Connected components of a table of links, without gathering any group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchframe.session import in_parts, write_out


def stars(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the stored links ``edges(a, b)`` but the roots; the root is the least node of its component.

    Alternating star steps: a node's neighbours above it, then those below it, are handed to the least
    one, until only stars are left.  A step is a minimum per node, which pre-aggregates,
    and a join of two stored tables, which adaptive execution may split at a node with many links.
    No step makes more than twice as many links as there are; the tables are stored in as many parts as that asks for.
    """
    for _ in range(rounds):
        bound = 2 * edges.count()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = write_out(in_parts(both.groupBy("a").agg(F.min("b").alias("m")), bound), "least").select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = write_out(in_parts(large.where("a <> b").distinct(), bound), "links")
        least = write_out(in_parts(edges.groupBy("a").agg(F.min("b").alias("m")), bound), "least")
        joined = edges.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = write_out(in_parts(small, bound), "links")
        if _only_stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"links did not settle in {rounds} rounds")


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node that has a lesser one has only that, and is the lesser one of none; a further step would change nothing."""
    ends = edges.selectExpr("a as node", "1 as up", "0 as down").unionByName(edges.selectExpr("b as node", "0 as up", "1 as down"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the least node of its component."""
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = stars(write_out(ordered.distinct(), "links"), rounds)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
