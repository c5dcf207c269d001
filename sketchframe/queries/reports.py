"""Queries for aggregates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sketchframe.operators import linear, stats
from sketchframe.queries.registry import CUST_PART, CUST_ROWS, EMB, EMB_DIM, EMB_ROWS, PART_COUNT, query, r6, rounded, select
from sketchframe.queries.sketches import CUST, party_sampled_sql, two_parties, vectors
from sketchframe.sources import views

CELLS = "tot as (select count(*)::double as c, min(v) as low, sum(v) as s1, sum(v * v) as s2 from x)"
SIZE = "size as (select (select count(*) from rws)::double as m, n::double as n from dim)"


@query(
    "matrix_min",
    select("select case when c < m * n then least(low, 0.0::double) else low end as min_v from tot, size", CUST_PART, CUST_ROWS, PART_COUNT, CELLS, SIZE),
)
def matrix_min(spark, root):
    return stats.matrix_min(views.cust_part(spark, root), views.cust_rows(spark, root).count(), views.part_count(spark, root))


@query(
    "matrix_variance",
    select(f"select {r6('s2 / (m * n) - (s1 / (m * n)) * (s1 / (m * n))')} as variance from tot, size", CUST_PART, CUST_ROWS, PART_COUNT, CELLS, SIZE),
)
def matrix_variance(spark, root):
    m, n = views.cust_rows(spark, root).count(), views.part_count(spark, root)
    return stats.matrix_variance(views.cust_part(spark, root), m, n).withColumn("variance", rounded("variance"))


@query(
    "gamma_resolve",
    select(
        f"select {r6('1.0::double / n', 12)} as base, {r6('(1.0::double / n) / (s2 / (m * n) - (s1 / (m * n)) * (s1 / (m * n)))', 12)} as gamma from tot, size",
        EMB,
        EMB_ROWS,
        EMB_DIM,
        CELLS,
        SIZE,
    ),
)
def gamma_resolve(spark, root):
    x, rows = vectors(spark, root)
    found = stats.resolve_gamma(x, rows.count(), views.emb_width(spark, root))
    return found.select(rounded("base", 12).alias("base"), rounded("gamma", 12).alias("gamma"))


@query(
    "class_summary",
    "select c_nationkey as label, count(*) filter (c_acctbal >= 0) as train_rows, count(*) filter (c_acctbal < 0) as test_rows"
    " from customer group by 1",
)
def class_summary(spark, root):
    y = views.table(spark, root, "customer").select(F.col("c_nationkey").alias("label"), "c_acctbal")
    return stats.class_summary(y.where("c_acctbal >= 0"), y.where("c_acctbal < 0"))


@query(
    "shape_report",
    select(
        "select 'a' as name, count(distinct row_id) as n_rows, count(distinct j) as n_cols from sa"
        " union all select 'b', count(distinct row_id), count(distinct j) from sb",
        CUST,
        party_sampled_sql("SM"),
    ),
)
def shape_report(spark, root):
    a, b, _, _ = two_parties(spark, root)
    return stats.shape_report({"a": a, "b": b})


_ZEROS = "count(*) filter (j = 0 and s in (-1, 0)) as empty_rows, count(*) filter (s in (-1, 0)) as empty_samples"


@query(
    "zero_report",
    select(f"select 'a' as name, {_ZEROS} from sa union all select 'b', {_ZEROS} from sb", CUST, party_sampled_sql("SM")),
)
def zero_report(spark, root):
    a, b, _, _ = two_parties(spark, root)
    return stats.zero_report({"a": a, "b": b})


@query(
    "accuracy",
    f"select {r6('avg(((o_totalprice > 150000)::int = (o_orderpriority <= ' + chr(39) + '2-HIGH' + chr(39) + ')::int)::int)')} as accuracy, count(*) as n_rows from orders",
)
def accuracy(spark, root):
    """Is a large order an urgent one?"""
    orders = views.table(spark, root, "orders").select(
        (F.col("o_totalprice") > 150000).cast("int").alias("prediction"), (F.col("o_orderpriority") <= "2-HIGH").cast("int").alias("label")
    )
    return stats.accuracy(orders).withColumn("accuracy", rounded("accuracy"))


EPOCHS = (
    "e as (select date_diff('day', timestamp '2024-01-01', ts)::int as epoch, avg((value > 50)::int) as accuracy,"
    " avg(value) as loss from events group by 1)"
)


def day_epochs(spark, root):
    """One epoch per day of events: its mean value and the share of values above 50."""
    events = views.table(spark, root, "events")
    epoch = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("epoch")
    hit = (F.col("value") > 50).cast("double")
    return events.groupBy(epoch).agg(F.avg(hit).alias("accuracy"), F.avg("value").alias("loss"))


@query(
    "best_epoch",
    select(f"select epoch, {r6('accuracy')} as accuracy, {r6('loss')} as loss from e order by e.accuracy desc, epoch limit 1", EPOCHS),
)
def best_epoch(spark, root):
    best = stats.best_epoch(day_epochs(spark, root))
    return best.select("epoch", rounded("accuracy").alias("accuracy"), rounded("loss").alias("loss"))


@query(
    "stop_rule",
    select(
        "select epoch as stop_epoch, case when bad <= epoch then 'NaN' when conv then 'converged' else 'max_iter' end as status from"
        " (select epoch, coalesce(abs(lag(loss) over (order by epoch) - loss) < 0.5, false) as conv, loss from e),"
        " (select min(epoch) filter (not loss < 100000) as bad from e) where conv or epoch >= 25 order by epoch limit 1",
        EPOCHS,
    ),
)
def stop_rule(spark, root):
    return linear.stop_rule(day_epochs(spark, root), max_iter=25, eps=0.5)
