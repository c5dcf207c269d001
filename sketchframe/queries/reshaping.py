"""Queries for projections, filters, reshaping, joins and scalers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchframe.operators import joins, reshape, scale
from sketchframe.queries.registry import (
    CUST_PART,
    CUST_ROWS,
    EMB,
    EMB_DIM,
    EMB_ROWS,
    EVENT_MIX,
    EVENT_ROWS,
    PART_COUNT,
    hashed,
    key_sql,
    query,
    r6,
    rounded,
    select,
)
from sketchframe.sources import views


def both(first: DataFrame, second: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """Two tables under one tag column."""
    return first.withColumn(name, F.lit(a)).unionByName(second.withColumn(name, F.lit(b)))


def emb_splits(spark, root):
    """Vectors of the first eight labels, and the rest."""
    y = views.emb_labels(spark, root)
    train, test = y.where(F.col("label") < 8), y.where(F.col("label") >= 8)
    x = views.emb(spark, root)
    return x.join(train, "row_id").drop("label"), x.join(test, "row_id").drop("label"), train, test


EMB_SPLIT = "lab as (select vec_id as row_id, case when label < 8 then 'train' else 'test' end as split from embeddings)"


@query(
    "row_sample",
    select(
        "select x.row_id, x.f, x.v from x join picked using (row_id)",
        CUST_PART,
        hashed("hr", f"select c_custkey as row_id, {key_sql(1, 'row')} as k, c_custkey as a from customer", two=False),
        "picked as (select row_id from (select row_id, row_number() over (order by h, row_id) as rn,"
        " count(*) over () as m from hr) where rn <= (2 * m) // 5)",
    ),
)
def row_sample(spark, root):
    rows = views.cust_rows(spark, root)
    return reshape.sample_rows(views.cust_part(spark, root), rows, 2 * rows.count() // 5)


@query("fit_width", select("select row_id, f, v from x, dim where f < n // 2", CUST_PART, PART_COUNT))
def fit_width(spark, root):
    n = views.part_count(spark, root)
    return reshape.fit_width(views.cust_part(spark, root), n // 2, on_overflow="truncate")


def _split_sql(cut: str) -> str:
    return select(
        f"select case when f < n1 then 'a' else 'b' end as party, row_id, case when f < n1 then f else f - n1 end as f, v"
        f" from x, (select {cut} as n1 from dim)",
        CUST_PART,
        PART_COUNT,
    )


@query("vsplit_portion", _split_sql("floor(n * 0.3::double)::bigint"))
def vsplit_portion(spark, root):
    a, b = reshape.vertical_split(views.cust_part(spark, root), views.part_count(spark, root), 0.3)
    return both(a, b, "party", "a", "b")


@query("vsplit_at", _split_sql("n // 4"))
def vsplit_at(spark, root):
    a, b = reshape.vertical_split_at(views.cust_part(spark, root), views.part_count(spark, root) // 4)
    return both(a, b, "party", "a", "b")


@query(
    "sign_separate",
    select(
        "select split, row_id, case when low < 0 then 2 * f + (v < 0)::bigint else f end as f,"
        " case when low < 0 then abs(v) else v end as v, (case when low < 0 then 2 * n else n end)::bigint as width"
        " from x join lab using (row_id), dim, (select min(v) as low from x)",
        EMB,
        EMB_DIM,
        EMB_SPLIT,
    ),
)
def sign_separate(spark, root):
    train, test, _, _ = emb_splits(spark, root)
    a, b, width = reshape.separate_signs(train, test, views.emb_width(spark, root))
    return both(a, b, "split", "train", "test").withColumn("width", F.lit(width).cast("bigint"))


@query("filter_positive", select("select * from x where v > 0", EMB))
def filter_positive(spark, root):
    return reshape.positive_part(views.emb(spark, root))


@query(
    "add_bias",
    select("select row_id, f + 1 as f, v from x union all select row_id, 0, 1.0::double from rws", CUST_PART, CUST_ROWS),
)
def add_bias(spark, root):
    return reshape.add_bias(views.cust_part(spark, root), views.cust_rows(spark, root))


@query("transpose", select("select f as row_id, row_id as f, v from x", CUST_PART))
def transpose(spark, root):
    return reshape.transpose(views.cust_part(spark, root))


@query(
    "head_rows",
    select("select x.* from x where row_id in (select row_id from rws order by row_id limit 100)", CUST_PART, CUST_ROWS),
)
def head_rows(spark, root):
    return reshape.head_rows(views.cust_part(spark, root), views.cust_rows(spark, root), 100)


@query(
    "densify",
    select(
        f"select row_id, c.f, {r6('coalesce(v, 0.0)')} as v from rws cross join (select range as f from range(5)) c"
        " left join x using (row_id, f)",
        EVENT_MIX,
        EVENT_ROWS,
    ),
)
def densify(spark, root):
    types = views.event_types(spark, root)
    dense = reshape.to_dense(views.event_mix(spark, root, types), views.event_rows(spark, root), len(types))
    return dense.withColumn("v", rounded("v"))


CUST_LABELS = "case when c_acctbal < 0 then -1 when c_acctbal > 5000 then 1 else 2 end"


@query(
    "labels_binarize",
    select(
        "select split, row_id, (case when (select max((label = -1)::int) from y where split = 'train') = 1"
        " then (label = 1)::int else label end)::int as label from y",
        f"y as (select case when c_nationkey < 20 then 'train' else 'test' end as split, c_custkey as row_id, {CUST_LABELS} as label from customer)",
    ),
)
def labels_binarize(spark, root):
    customers = views.table(spark, root, "customer")
    label = F.when(F.col("c_acctbal") < 0, -1).when(F.col("c_acctbal") > 5000, 1).otherwise(2)
    y = customers.select("c_nationkey", F.col("c_custkey").alias("row_id"), label.alias("label"))
    train, test = y.where("c_nationkey < 20"), y.where("c_nationkey >= 20")
    a, b = reshape.binarize_labels(train.drop("c_nationkey"), test.drop("c_nationkey"))
    return both(a, b, "split", "train", "test")


@query(
    "labels_ovr",
    "select c.label as class, vec_id as row_id, (e.label = c.label)::int as label"
    " from embeddings e, (select distinct label from embeddings) c",
)
def labels_ovr(spark, root):
    return reshape.ovr_labels(views.emb_labels(spark, root))


@query(
    "cast_inputs",
    "select l_orderkey as row_id, l_linenumber::bigint as f, l_extendedprice::float::double as v,"
    " trunc(o_totalprice)::int as label from lineitem join orders on l_orderkey = o_orderkey",
)
def cast_inputs(spark, root):
    lines = views.table(spark, root, "lineitem")
    x = lines.select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").cast("bigint").alias("f"), F.col("l_extendedprice").alias("v"))
    y = views.table(spark, root, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("label"))
    x, y = reshape.cast_inputs(x, y)
    return x.join(y, "row_id").withColumn("v", F.col("v").cast("double"))


BATCHES = "b as (select row_id, ((row_number() over (order by row_id)) - 1) // 64 as batch from rws)"


@query(
    "batch_rows",
    select("select row_id, batch, count(*) over (partition by batch) as size from b", CUST_ROWS, BATCHES),
)
def batch_rows(spark, root):
    batches = reshape.batch_rows(views.cust_rows(spark, root), 64)
    return batches.join(reshape.batch_sizes(batches), "batch")


@query(
    "batch_shuffle",
    select(
        "select batch, (row_number() over (order by h, batch)) - 1 as position from hb",
        CUST_ROWS,
        BATCHES,
        hashed("hb", f"select distinct batch, {key_sql(1, 'batch')} as k, batch as a, 3 as b from b"),
    ),
)
def batch_shuffle(spark, root):
    return reshape.shuffle_batches(reshape.batch_rows(views.cust_rows(spark, root), 64), seed=1, epoch=3)


@query(
    "align_parties",
    "select c_custkey as row_id, c_acctbal as balance, n_orders from customer join"
    " (select o_custkey, count(*) as n_orders from orders group by 1) on c_custkey = o_custkey",
)
def align_parties(spark, root):
    a = views.table(spark, root, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("balance"))
    b = views.table(spark, root, "orders").groupBy(F.col("o_custkey").alias("row_id")).agg(F.count("*").alias("n_orders"))
    return joins.align_parties(a, b, strict=False)


@query(
    "align_check",
    "select c_custkey as row_id, 'a' as side from customer where c_custkey not in (select o_custkey from orders)"
    " union all select distinct o_custkey, 'b' from orders where o_custkey not in (select c_custkey from customer)",
)
def align_check(spark, root):
    a = views.cust_rows(spark, root)
    b = views.table(spark, root, "orders").select(F.col("o_custkey").alias("row_id")).distinct()
    return joins.unmatched_rows(a, b)


@query("hstack", select("select row_id, f, v from x", CUST_PART))
def hstack(spark, root):
    n1 = views.part_count(spark, root) // 4
    a, b = reshape.vertical_split_at(views.cust_part(spark, root), n1)
    return joins.hstack(a, b, n1)


DENSE_EVENTS = (
    "d as (select row_id, c.f, coalesce(v, 0.0) as v from rws cross join (select range as f from range(5)) c"
    " left join x using (row_id, f))"
)
DENSE_EMB = (
    "d as (select row_id, c.f, coalesce(v, 0.0) as v from rws cross join (select unnest(range(n)) as f from dim) c"
    " left join x using (row_id, f))"
)


@query(
    "scale_minmax",
    select(
        f"select row_id, f, {r6('v')} as v from (select row_id, f, (v - lo) / (case when hi = lo then 1 else hi - lo end) as v"
        " from d join (select f, min(v) as lo, max(v) as hi from d group by f) using (f)) where v <> 0",
        EVENT_MIX,
        EVENT_ROWS,
        DENSE_EVENTS,
    ),
)
def scale_minmax(spark, root):
    types = views.event_types(spark, root)
    x, rows = views.event_mix(spark, root, types), views.event_rows(spark, root)
    return scale.scale_minmax(x, rows, rows.count(), len(types)).withColumn("v", rounded("v"))


@query(
    "scale_standard",
    select(
        f"select row_id, f, {r6('v')} as v from (select row_id, f, (v - mu) / (case when sd = 0 then 1 else sd end) as v"
        " from d join (select f, avg(v) as mu, stddev_pop(v) as sd from d group by f) using (f)) where v <> 0",
        EMB,
        EMB_ROWS,
        EMB_DIM,
        DENSE_EMB,
    ),
)
def scale_standard(spark, root):
    x, rows = views.emb(spark, root), views.table(spark, root, "embeddings").select(F.col("vec_id").alias("row_id"))
    return scale.scale_standard(x, rows, rows.count(), views.emb_width(spark, root)).withColumn("v", rounded("v"))


@query(
    "scale_robust",
    select(
        f"select row_id, f, {r6('v')} as v from (select row_id, f, (v - med) / (case when iqr = 0 then 1 else iqr end) as v"
        " from d join (select f, quantile_cont(v, 0.5) as med, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as iqr"
        " from d group by f) using (f)) where v <> 0",
        EMB,
        EMB_ROWS,
        EMB_DIM,
        DENSE_EMB,
    ),
)
def scale_robust(spark, root):
    x, rows = views.emb(spark, root), views.table(spark, root, "embeddings").select(F.col("vec_id").alias("row_id"))
    return scale.scale_robust(x, rows, rows.count(), views.emb_width(spark, root)).withColumn("v", rounded("v"))


@query(
    "scale_l2",
    select(
        f"select row_id, f, {r6('v / norm')} as v from x join (select row_id, sqrt(sum(v * v)) as norm from x group by 1) using (row_id)",
        CUST_PART,
    ),
)
def scale_l2(spark, root):
    return scale.scale_normalize(views.cust_part(spark, root)).withColumn("v", rounded("v"))


@query(
    "scale_maxabs",
    select(
        f"select row_id, f, {r6('v / top')} as v from x join (select f, max(abs(v)) as top from x group by 1) using (f)",
        CUST_PART,
    ),
)
def scale_maxabs(spark, root):
    scaled = scale.scale_maxabs(views.cust_part(spark, root), views.part_count(spark, root))
    return scaled.withColumn("v", rounded("v"))
