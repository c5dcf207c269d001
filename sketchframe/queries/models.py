"""Queries for linear models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sketchframe.functions.numeric import approx_sigmoid
from sketchframe.operators import expand, linear, reshape, sketch
from sketchframe.queries.registry import CUST_PART, CUST_ROWS, query, r6, rounded, select
from sketchframe.queries.sketches import SEED, customers, vectors
from sketchframe.session import fresh_path, write_out
from sketchframe.sources import views

# --- library solver: no SQL form ---------------------------------------------

LR_K, LR_C = 32, 16


def quality_model(spark, root):
    """Document quality from a compressed min-hash sketch of the words."""
    y = views.doc_labels(spark, root)
    rows = y.select("row_id")
    samples = sketch.one_based(sketch.p_minhash(views.doc_terms(spark, root, labelled=True), rows, LR_K, SEED))
    features = expand.sketch_count(samples, LR_C)
    data = write_out(linear.to_vectors(features, rows, LR_K * LR_C), "vectors")
    return linear.train_linear(data, y, C=1.0), data, y


@query("lr_train")
def lr_train(spark, root):
    fitted, _, _ = quality_model(spark, root)
    return linear.model_weights(spark, fitted).withColumn("w", rounded("w", 3))


@query("lr_predict")
def lr_predict(spark, root):
    fitted, data, y = quality_model(spark, root)
    return linear.predict_linear(fitted, data).join(y, "row_id")


# --- scoring -------------------------------------------------------------------

# Weights of a part follow from its size; multiples of 1/1024 add up exactly.
WEIGHTS = "w as (select p_partkey as f, (p_size - 25) / 1024.0::double as w from part)"
SCORES = "z as (select row_id, coalesce(z, 0.0::double) as z from rws left join (select row_id, sum(v * w) as z from x join w using (f) group by 1) using (row_id))"
SCORED = [CUST_PART, CUST_ROWS, WEIGHTS, SCORES]


def part_weights(spark, root):
    parts = views.table(spark, root, "part")
    return parts.select(F.col("p_partkey").alias("f"), ((F.col("p_size") - 25) / F.lit(1024.0)).alias("w"))


def cust_scores(spark, root):
    x, rows = customers(spark, root)
    return linear.linear_scores(x, rows, part_weights(spark, root), views.part_count(spark, root))


LOGISTIC = "1.0::double / (1.0::double + exp(-z))"


@query("logit_score", select(f"select row_id, {r6(LOGISTIC)} as probability from z", SCORED))
def logit_score(spark, root):
    x, rows = customers(spark, root)
    scored = linear.logit_score(x, rows, part_weights(spark, root), views.part_count(spark, root))
    return scored.withColumn("probability", rounded("probability"))


@query("threshold_classify", select("select row_id, case when z >= 0 then 1 else -1 end::int as prediction from z", SCORED))
def threshold_classify(spark, root):
    x, rows = customers(spark, root)
    scored = linear.logit_score(x, rows, part_weights(spark, root), views.part_count(spark, root))
    return linear.threshold_classify(scored).select("row_id", "prediction")


SIGMOIDS = {
    "linear": "0.25::double * z + 0.5::double",
    "cube": "0.5::double + 0.197::double * z - 0.004::double * z * z * z",
    "segment": "case when z > -0.5 and z < 0.5 then z else 0.0::double end",
}


def _register_sigmoid(kind: str, expression: str) -> None:
    @query(f"sigmoid_{kind}", select(f"select row_id, {r6(expression)} as y from z", SCORED))
    def run(spark, root):
        return cust_scores(spark, root).select("row_id", rounded(approx_sigmoid(F.col("z"), kind)).alias("y"))


for _kind, _expression in SIGMOIDS.items():
    _register_sigmoid(_kind, _expression)


@query(
    "taylor_loss",
    select(
        f"select {r6('sum(q) / sum(size)')} as loss from (select count(*) as size,"
        f" sum((-0.5::double * z + label * z - 0.125::double * z * z) * (-1.0::double / size) - ({math.log(0.5)!r}::double)) as q"
        " from (select z, label, batch, count(*) over (partition by batch) as size from z join y using (row_id)) group by batch)",
        SCORED,
        "y as (select c_custkey as row_id, (c_acctbal > 5000)::int as label, ((row_number() over (order by c_custkey)) - 1) // 64 as batch from customer)",
    ),
)
def taylor_loss(spark, root):
    y = rich_customers(spark, root)
    batches = reshape.batch_rows(y.select("row_id"), 64)
    scored = cust_scores(spark, root).join(y, "row_id").join(batches, "row_id")
    return linear.taylor_loss(scored).withColumn("loss", rounded("loss"))


def rich_customers(spark, root):
    customer = views.table(spark, root, "customer")
    return customer.select(F.col("c_custkey").alias("row_id"), (F.col("c_acctbal") > 5000).cast("int").alias("label"))


EPOCH_WEIGHTS = (
    "w as (select 1 as class, e as epoch, p_partkey as f, (p_size - 20 - e) / 1024.0::double as w from part, (values (2), (4), (6)) t(e))"
)


@query(
    "score_epochs",
    select(
        f"select epoch, {r6('avg(((z >= 0)::int = label)::int)')} as accuracy from (select epoch, row_id, coalesce(z, 0) as z"
        " from rws cross join (select distinct epoch from w) left join (select epoch, row_id, sum(v * w) as z from x join w using (f) group by 1, 2)"
        " using (epoch, row_id)) join (select c_custkey as row_id, (c_acctbal > 5000)::int as label from customer) using (row_id) group by 1",
        CUST_PART,
        CUST_ROWS,
        EPOCH_WEIGHTS,
    ),
)
def score_epochs(spark, root):
    """Accuracy after epochs 2, 4 and 6; the gaps are no error."""
    x, _ = customers(spark, root)
    parts = views.table(spark, root, "part")
    weights = parts.select(
        F.lit(1).alias("class"),
        F.explode(F.array(F.lit(2), F.lit(4), F.lit(6))).alias("epoch"),
        F.col("p_partkey").alias("f"),
        "p_size",
    ).select("class", "epoch", "f", ((F.col("p_size") - 20 - F.col("epoch")) / F.lit(1024.0)).alias("w"))
    scored = linear.score_epochs(x, rich_customers(spark, root), weights, 3 * views.part_count(spark, root))
    return scored.withColumn("accuracy", rounded("accuracy"))


@query(
    "ovr_predict",
    select(
        "select row_id, class as prediction from (select row_id, class, row_number() over (partition by row_id order by z desc, class) as rn"
        " from (select row_id, class, coalesce(z, 0) as z from rws cross join (select range::int as class from range(5))"
        " left join (select class, row_id, sum(v * w) as z from x join w using (f) group by 1, 2) using (class, row_id))) where rn = 1",
        CUST_PART,
        CUST_ROWS,
        "w as (select c::int as class, p_partkey as f, ((p_size * (c + 1)) % 51 - 25) / 1024.0::double as w from part, (select range as c from range(5)))",
    ),
)
def ovr_predict(spark, root):
    x, rows = customers(spark, root)
    parts = views.table(spark, root, "part")
    classes = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("class")
    score = (F.pmod(F.col("p_size") * (F.col("class") + 1), F.lit(51)) - 25) / F.lit(1024.0)
    fanned = parts.select(classes, F.lit(1).alias("epoch"), F.col("p_partkey").alias("f"), "p_size")
    weights = fanned.select("class", "epoch", "f", score.alias("w"))
    scores = linear.epoch_scores(x, rows, weights, 5 * views.part_count(spark, root))
    return linear.ovr_predict(scores).select("row_id", "prediction")


# --- mini-batch training ----------------------------------------------------------


def _trained_sql(rows: str, classes: list[int], width: int, batch_size: int, alpha: float, lam: float, epochs: int) -> list[str]:
    """CTE ``t(step, class, w)``: the weights after every step, whatever the number of batches.

    ``rows`` selects (row_id, label, x), x being the list of ``width`` features; a recursion takes one batch a step.
    """
    sums = ", ".join(f"sum(e * x[{i}])" for i in range(1, width + 1))
    return [
        f"r as materialized (select *, count(*) over (partition by batch)::double as size from (select *, ((row_number() over (order by row_id)) - 1) // {batch_size} as batch from ({rows})))",
        "nb as materialized (select max(batch) + 1 as n from r)",
        f"""t as (
            select 0::bigint as step, unnest({classes}) as class, list_transform(range({width}), lambda i: 0.0::double) as w
            union all
            select step + 1, class, list_transform(range(1, {width + 1}), lambda i: w[i] * (1 - {lam}::double * {alpha} / size) - {alpha}::double * g[i])
            from (
                select step, class, any_value(w) as w, any_value(size) as size, [{sums}] as g
                from (
                    select step, class, w, x, size, (0.25::double * list_inner_product(w, x) + 0.5::double - (label = class)::int) / size as e
                    from t, nb, r where r.batch = t.step % nb.n and t.step < {epochs} * nb.n
                )
                group by step, class
            )
        )""",
    ]


def _recursive(ctes: list[str], final: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n" + final


STEPS = {"batch_size": 250, "alpha": 0.5, "lam": 0.1, "epochs": 2}
EMB_WIDTH = 64
EMB_LIST = "list_transform(embedding, lambda c: c::double) as x"


@query(
    "minibatch_lr",
    _recursive(
        _trained_sql(f"select vec_id as row_id, (label < 5)::int as label, {EMB_LIST} from embeddings", [1], EMB_WIDTH, **STEPS),
        f"select (step // n)::int as epoch, unnest(range({EMB_WIDTH}))::bigint as f, {r6('unnest(w)')} as w from t, nb where step > 0 and step % n = 0",
    ),
)
def minibatch_lr(spark, root):
    x, _ = vectors(spark, root)
    y = views.emb_labels(spark, root).withColumn("label", (F.col("label") < 5).cast("int"))
    cfg = linear.MinibatchConfig(width=views.emb_width(spark, root), stop_on_converge=False, **STEPS)
    model = linear.minibatch_lr(x, y, cfg)
    return model.weights.select("epoch", "f", rounded("w").alias("w"))


BEST = {"batch_size": 100, "alpha": 2.0, "lam": 0.1, "epochs": 4}
CLASSES = [0, 1, 2]


@query(
    "train_best_epoch",
    _recursive(
        [
            *_trained_sql(f"select vec_id as row_id, label % 3 as label, {EMB_LIST} from embeddings where vec_id % 4 <> 0", CLASSES, EMB_WIDTH, **BEST),
            f"held as (select vec_id as row_id, label % 3 as label, {EMB_LIST} from embeddings where vec_id % 4 = 0)",
            "z as (select (step // n)::int as epoch, row_id, label, class, list_inner_product(w, x) as z from t, nb, held where step > 0 and step % n = 0)",
            "guess as (select epoch, row_id, label, class, row_number() over (partition by epoch, row_id order by z desc, class) as place from z)",
            "scored as (select epoch, avg((class = label)::int) as accuracy from guess where place = 1 group by epoch)",
        ],
        f"select epoch, {r6('accuracy')} as accuracy, row_number() over (order by accuracy desc, epoch) = 1 as best from scored",
    ),
)
def train_best_epoch(spark, root):
    """Three one-vs-rest models trained on three quarters of the embeddings, scored after every epoch on the last quarter."""
    x, _ = vectors(spark, root)
    y = views.emb_labels(spark, root).withColumn("label", F.col("label") % 3)
    learn, held = y.where("row_id % 4 <> 0"), y.where("row_id % 4 = 0")
    cfg = linear.MinibatchConfig(width=views.emb_width(spark, root), stop_on_converge=False, **BEST)
    run = fresh_path(spark, "training")
    _, epochs = linear.train_best_epoch(run, x.join(learn.select("row_id"), "row_id"), learn, x.join(held.select("row_id"), "row_id"), held, cfg, CLASSES)
    return epochs.withColumn("accuracy", rounded("accuracy"))
