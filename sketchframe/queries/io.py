"""Queries that write files to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sketchframe.operators import expand, sketch
from sketchframe.queries.registry import CUST_PART, CUST_ROWS, K, PART_COUNT, query, select
from sketchframe.queries.sketches import COUNT_SQL, CUST, SEED, SM, based_samples, customers, sampled_sql
from sketchframe.session import fresh_path
from sketchframe.sources import samples as files
from sketchframe.sources import svmlight, views
from sketchframe.sources.dense import read_dense_csv

VECTOR_CELLS = (
    "select vec_id as row_id, (pos - 1)::bigint as f, embedding[pos]::double as v"
    " from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as pos from embeddings) where embedding[pos] <> 0"
)


@query("src_svmlight", VECTOR_CELLS)
def src_svmlight(spark, root):
    """Vectors as compressed svmlight text; the label carries the vector's id."""
    path = fresh_path(spark, "vectors")
    lines = views.table(spark, root, "embeddings").select(F.col("vec_id").alias("label"), F.col("embedding").alias("values"))
    svmlight.write_svmlight(lines, path, compression="bzip2")
    data = svmlight.read_svmlight(spark, path)
    named = data.y.select("row_id", F.col("label").cast("bigint").alias("id"))
    return data.x.join(named, "row_id").select(F.col("id").alias("row_id"), "f", "v")


@query(
    "src_svmlight_rows",
    "select count(*) as n_rows, min(i) as first, max(i) as last, count(distinct i) as distinct_ids"
    " from (select row_number() over () - 1 as i from customer)",
)
def src_svmlight_rows(spark, root):
    """Line numbers of a file of many blocks are contiguous from 0."""
    path = fresh_path(spark, "customers")
    lines = views.table(spark, root, "customer").select(
        F.col("c_nationkey").alias("label"), F.array(F.col("c_acctbal").cast("float")).alias("values")
    )
    svmlight.write_svmlight(lines.repartition(7), path)
    rows = svmlight.read_svmlight(spark, path, n=1, zero_based=False).rows
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.min("row_id").alias("first"),
        F.max("row_id").alias("last"),
        F.countDistinct("row_id").alias("distinct_ids"),
    )


@query("src_weighted_set", select("select row_id, f, v from x", CUST_PART))
def src_weighted_set(spark, root):
    return views.cust_part(spark, root)


@query(
    "sink_samples",
    select("select row_id || ',' || string_agg(s, ',' order by j) as value from s group by row_id", CUST, SM),
)
def sink_samples(spark, root):
    path = fresh_path(spark, "samples")
    files.write_samples(based_samples(spark, root), path)
    return spark.read.text(path)


@query("src_samples", select("select row_id, j, s from s", CUST, SM))
def src_samples(spark, root):
    path = fresh_path(spark, "samples")
    files.write_samples(based_samples(spark, root), path)
    return files.read_samples(spark, path)


@query("sink_sketch", COUNT_SQL)
def sink_sketch(spark, root):
    path = fresh_path(spark, "sketch")
    files.write_sketch(expand.sketch_count(based_samples(spark, root), 16), path)
    return files.read_sketch(spark, path)


@query(
    "sink_dense_sketch",
    f"select rank as row_id, col, v::double as v from ({COUNT_SQL}) join"
    " (select c_custkey as row_id, row_number() over (order by c_custkey) - 1 as rank from customer) using (row_id)",
)
def sink_dense_sketch(spark, root):
    """A sketch as dense text and back; lines follow the order of the rows."""
    path = fresh_path(spark, "dense")
    rows = customers(spark, root)[1]
    files.export_dense_csv(expand.sketch_count(based_samples(spark, root), 16), rows, 16 * K, path)
    return read_dense_csv(spark, path)


@query(
    "sink_partitioned",
    select("select row_id, j, s, 0.3::double as ratio, 2::int as seed from m", CUST_PART, CUST_ROWS, PART_COUNT, sampled_sql("m", "SM", seed=2)),
)
def sink_partitioned(spark, root):
    """Two runs in one layout; reading one prunes the other's folder."""
    layout = fresh_path(spark, "runs")
    x, rows = customers(spark, root)
    for seed in (SEED, SEED + 1):
        files.write_run(sketch.p_minhash(x, rows, K, seed), layout, "customers", 0.3, "SM", K, seed)
    return files.read_run(spark, layout, method="SM", seed=2).select("row_id", "j", "s", "ratio", "seed")
