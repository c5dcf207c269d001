"""Linear models on long feature tables.

Features are X(row_id, f, v), labels y(row_id, label), weights W with a column
``f`` and optional ``class`` and ``epoch``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchframe.functions.numeric import approx_sigmoid, logistic, taylor_term, threshold
from sketchframe.operators.reshape import batch_rows, batch_sizes, to_dense
from sketchframe.operators.stats import best_epoch
from sketchframe.operators.training import WEIGHTS, MinibatchConfig, MinibatchModel, train_run
from sketchframe.session import fresh_path, maybe_broadcast, write_out


def linear_scores(df: DataFrame, rows: DataFrame, weights: DataFrame, width: int | None = None) -> DataFrame:
    """(row_id, z) with z = x.w; rows without cells score 0.

    The weights are broadcast only when ``width`` proves them small.
    """
    product = df.join(maybe_broadcast(weights.select("f", "w"), width), "f")
    terms = product.select("row_id", (F.col("v") * F.col("w")).alias("p"))
    zeros = rows.select("row_id", F.lit(0.0).alias("p"))
    return terms.unionByName(zeros).groupBy("row_id").agg(F.sum("p").alias("z"))


def logit_score(df: DataFrame, rows: DataFrame, weights: DataFrame, width: int | None = None) -> DataFrame:
    """(row_id, probability)."""
    scores = linear_scores(df, rows, weights, width)
    return scores.select("row_id", logistic(F.col("z")).alias("probability"))


def threshold_classify(scored: DataFrame, cut: float = 0.5, negative: int = -1) -> DataFrame:
    return scored.withColumn("prediction", threshold(F.col("probability"), cut, negative))


# --- library solver ---------------------------------------------------------


def to_vectors(features: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(row_id, features) as sparse MLlib vectors; ``features`` has a column ``col``.

    A vector is stored as (type 0, size, indices, values).  No built-in function
    makes a sparse one from arrays, but the JSON reader fills the vector type,
    which keeps the assembly in the JVM.  Its size and indices are 32-bit, so wider tables raise an error.
    """
    if width >= 2**31:
        raise ValueError(f"a vector of width {width} does not fit; MLlib's indices have 31 bits")
    marker = rows.selectExpr("row_id", "cast(null as bigint) as col", "cast(null as double) as v")
    cells = features.select("row_id", "col", F.col("v").cast("double").alias("v")).unionByName(marker)
    entry = F.when(F.col("col").isNotNull(), F.struct("col", "v"))  # collect_list skips the marker's null
    packed = cells.groupBy("row_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    vector = F.struct(
        F.lit(0).alias("type"), F.lit(width).alias("size"), F.col("e.col").alias("indices"), F.col("e.v").alias("values")
    )
    text = F.to_json(F.struct(vector.alias("features")))
    shape = T.StructType([T.StructField("features", VectorUDT())])
    return packed.select("row_id", F.from_json(text, shape)["features"].alias("features"))


def to_dense_vectors(df: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(row_id, features) as dense MLlib vectors of a narrow table."""
    cells = to_dense(df, rows, n).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("e"))
    return cells.select("row_id", array_to_vector(F.col("e.v")).alias("features"))


ROWS_PER_TASK = 20_000


@dataclass(frozen=True)
class LinearModel:
    """A fitted MLlib model, the labels behind its class numbers, and whether every solver converged."""

    model: object
    classes: list[int]
    converged: bool = True


def train_linear(vectors: DataFrame, y: DataFrame, C: float = 1.0, tol: float = 1e-4, max_iter: int = 100, parallelism: int = 4) -> LinearModel:
    """L2-regularised logistic regression without intercept; one-vs-rest beyond two classes.

    The objective 1/2 |w|^2 + C * sum(loss), divided by C * m.
    """
    data = vectors.join(y, "row_id")
    classes = sorted(r[0] for r in y.select("label").distinct().collect())  # one entry per class
    m = y.count()
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    # A solver pass costs a task per partition, so small tables get few of them; the exchange keeps
    # what comes before it, the assembly of the vectors, as wide as it was.
    data = data.select("features", index.cast("double").alias("label")).repartition(1 + m // ROWS_PER_TASK).persist()
    solver = LogisticRegression(
        fitIntercept=False, standardization=False, regParam=1.0 / (C * m), tol=tol, maxIter=max_iter
    )
    try:
        if len(classes) > 2:
            solver = OneVsRest(classifier=solver, parallelism=parallelism)
        fitted = solver.fit(data)
        models = fitted.models if len(classes) > 2 else [fitted]
        done = all(part.summary.totalIterations < max_iter for part in models if part.hasSummary)
        return LinearModel(fitted, classes, done)
    finally:
        data.unpersist()


def predict_linear(fitted: LinearModel, vectors: DataFrame) -> DataFrame:
    """(row_id, prediction) in the labels the model was trained on."""
    names = F.array(*[F.lit(c) for c in fitted.classes])
    scored = fitted.model.transform(vectors)
    return scored.select("row_id", names[F.col("prediction").cast("int")].alias("prediction"))


def model_weights(spark: SparkSession, fitted: LinearModel) -> DataFrame:
    """Weights W(f, w) of a two-class model, zeros left out."""
    coefficients = fitted.model.coefficients.toArray()
    pairs = [(int(i), float(w)) for i, w in enumerate(coefficients) if w != 0]
    return spark.createDataFrame(pairs, "f bigint, w double")


# --- mini-batch training ----------------------------------------------------


class _JoinedSteps:
    """Steps of a model of any width: the weights are a table.

    Each step writes the new weights to the shared folder, which keeps the
    lineage short.  A batch has at most batch_size rows, so what is keyed by
    its rows may be broadcast; cells and weights are joined by shuffle.
    """

    def __init__(self, x: DataFrame, labels: DataFrame, cfg: MinibatchConfig):
        self.spark, self.cfg, self.labels = x.sparkSession, cfg, labels
        cells = x.join(labels.select("batch", "row_id"), "row_id").select("batch", "row_id", "f", "v")
        self.cells = write_out(cells.repartitionByRange("batch", "row_id").sortWithinPartitions("batch"), "cells")

    def start(self, classes: list[int]) -> DataFrame:
        return self.spark.createDataFrame([], WEIGHTS)

    def step(self, weights: DataFrame, batch: int, size: int, active: list[int]):
        cfg, here = self.cfg, F.col("batch") == batch
        cells, held = self.cells.where(here), len(active) * cfg.batch_size
        moving = weights.where(F.col("class").isin(active))
        scores = (
            cells.join(moving, "f")
            .select("class", "row_id", (F.col("v") * F.col("w")).alias("p"))
            .groupBy("class", "row_id")
            .agg(F.sum("p").alias("z"))
        )
        every = F.explode(F.array(*[F.lit(c) for c in active])).alias("class")
        targets = self.labels.where(here).select("row_id", "label", "size", every)
        z, target = F.coalesce("z", F.lit(0.0)), (F.col("label") == F.col("class")).cast("double")
        guess = approx_sigmoid(z, cfg.sigmoid)
        errors = targets.join(maybe_broadcast(scores, held), ["class", "row_id"], "left").select(
            "class",
            "row_id",
            ((guess - target) / F.col("size")).alias("e"),
            taylor_term(guess if cfg.loss_on == "prob" else z, target, F.col("size")).alias("loss"),
        )
        slope = F.sum(F.col("v") * F.col("e")).alias("g")
        gradient = cells.join(maybe_broadcast(errors, held), "row_id").groupBy("class", "f").agg(slope)
        decay = 1.0 - cfg.lam * cfg.alpha / size
        w = F.coalesce("w", F.lit(0.0)) * decay - F.coalesce("g", F.lit(0.0)) * (cfg.penalty * cfg.alpha)
        moved = moving.join(gradient, ["class", "f"], "full_outer").select("class", "f", w.alias("w"))
        still = weights.where(~F.col("class").isin(active))
        losses = {r["class"]: r["loss"] for r in errors.groupBy("class").agg(F.sum("loss").alias("loss")).collect()}
        return write_out(moved.unionByName(still), "step"), losses

    def table(self, weights: DataFrame) -> DataFrame:
        return weights.where("w <> 0")


def minibatch_lr(
    x: DataFrame, y: DataFrame, cfg: MinibatchConfig, classes: list[int] | None = None, packed: bool = True
) -> MinibatchModel:
    """Sequential mini-batch logistic regression; all classes share each pass.

    Rows are laid out once by batch, so a step reads its own batch.
    Without ``classes`` the labels are 0 and 1.  ``packed`` chooses how a step
    runs: with the weights as arrays (``train_run`` in a folder of its own), which are too large beyond
    ``BROADCAST_ROWS``, or as a table.  Both take features 0 to width - 1 only and store no zero weights.
    """
    spark = x.sparkSession
    if packed:
        return train_run(fresh_path(spark, "training"), x, y, cfg, classes)
    classes = list(classes or [1])
    low, high = x.agg(F.min("f"), F.max("f")).first()
    if low is not None and (low < 0 or high >= cfg.width):
        raise ValueError(f"features {low} to {high} do not fit a width of {cfg.width}")
    batches = batch_rows(y.select("row_id"), cfg.batch_size)
    batches = write_out(batches, "batches")
    labels = y.join(batches, "row_id").join(batch_sizes(batches), "batch").select("batch", "row_id", "label", "size")
    labels = write_out(labels.repartitionByRange("batch").sortWithinPartitions("batch"), "labels")
    m = labels.count()
    sizes = [min(cfg.batch_size, m - start) for start in range(0, m, cfg.batch_size)]
    steps = _JoinedSteps(x, labels, cfg)
    weights = steps.start(classes)
    snapshots = fresh_path(spark, "epochs")
    previous: dict[int, float] = {}
    active, log = list(classes), []
    for epoch in range(1, cfg.epochs + 1):
        total = dict.fromkeys(active, 0.0)
        for batch, size in enumerate(sizes):
            weights, losses = steps.step(weights, batch, size, active)
            for c, loss in losses.items():
                total[c] += loss
        steps.table(weights).write.parquet(f"{snapshots}/epoch={epoch}")
        done = set()
        for c in active:
            loss = total[c] / m
            overflow = not loss < 1e5
            converged = c in previous and abs(previous[c] - loss) < cfg.eps
            previous[c] = loss
            log.append((c, epoch, loss, "NaN" if overflow else "converged" if converged else "ok"))
            if (converged and cfg.stop_on_converge) or (overflow and cfg.stop_on_overflow):
                done.add(c)
        active = [c for c in active if c not in done]
        if not active:
            break
    kept = spark.read.schema(f"{WEIGHTS}, epoch int").parquet(snapshots)
    metrics = spark.createDataFrame(log, "class int, epoch int, loss double, status string")
    return MinibatchModel(kept.select("class", "epoch", "f", "w"), metrics)


def taylor_loss(scored: DataFrame) -> DataFrame:
    """Loss of a table (row_id, batch, z, label): summed over batches, per row."""
    sizes = scored.groupBy("batch").agg(
        F.count("*").alias("size"),
        F.sum(F.col("z") * F.lit(-0.5) + F.col("label") * F.col("z") + F.col("z") * F.col("z") * F.lit(-0.125)).alias("q"),
    )
    per_batch = F.col("q") * (F.lit(-1.0) / F.col("size")) - F.col("size") * F.lit(math.log(0.5))
    return sizes.agg((F.sum(per_batch) / F.sum("size")).alias("loss"))


def stop_rule(losses: DataFrame, max_iter: int, eps: float = 1e-5, on_converge: bool = True, on_overflow: bool = False) -> DataFrame:
    """(stop_epoch, status) of a loss table (epoch, loss), one row per epoch.

    A log that ends before any rule stops it gives its last epoch and ``ok``; ``NaN`` tells that a loss up to the
    stop was no number or at least 1e5, which with ``on_overflow`` is itself a reason to stop.
    """
    step = F.abs(F.lag("loss").over(Window.orderBy("epoch")) - F.col("loss"))  # a row per epoch
    finite = F.coalesce(F.col("loss") < 1e5, F.lit(False))  # false for NaN, which sorts above all numbers
    marked = losses.select(
        "epoch", (F.coalesce(step < eps, F.lit(False)) & F.lit(on_converge)).alias("converged"), (~finite).alias("overflow")
    )
    ends = F.col("converged") | (F.col("epoch") >= max_iter) | (F.col("overflow") & F.lit(on_overflow))
    why = F.when(F.col("converged"), "converged").otherwise("max_iter")
    summed = marked.agg(
        F.min(F.when(ends, F.struct("epoch", why.alias("why")))).alias("stop"),
        F.max("epoch").alias("last"),
        F.min(F.when(F.col("overflow"), F.col("epoch"))).alias("bad"),
    )
    at = F.coalesce("stop.epoch", "last")
    status = F.when(F.col("bad") <= at, "NaN").otherwise(F.coalesce("stop.why", F.lit("ok")))
    return summed.select(at.alias("stop_epoch"), status.alias("status")).where("stop_epoch is not null")


# --- scoring ----------------------------------------------------------------


MODELS_AT_ONCE = 64


def epoch_scores(df: DataFrame, rows: DataFrame, weights: DataFrame, weight_rows: int | None = None) -> DataFrame:
    """(class, epoch, row_id, z) for every stored epoch and class.

    A cell meets the weights of up to ``MODELS_AT_ONCE`` models at once and every model is one aggregate column, so the exchange
    carries a record per row and task, not one per model; they become rows after it.
    """
    models = [tuple(r) for r in weights.select("class", "epoch").distinct().orderBy("class", "epoch").collect()]  # a row per model
    scored = rows.select(F.lit(0).alias("class"), F.lit(0).alias("epoch"), "row_id", F.lit(0.0).alias("z")).where("false")
    for start in range(0, len(models), MODELS_AT_ONCE):
        some = _scores_of(models[start : start + MODELS_AT_ONCE], df, rows, weights, weight_rows)
        scored = some if start == 0 else scored.unionByName(some)
    return scored


def _scores_of(models: list[tuple[int, int]], df: DataFrame, rows: DataFrame, weights: DataFrame, weight_rows: int | None) -> DataFrame:
    own = [F.sum(F.when((F.col("class") == c) & (F.col("epoch") == e), F.col("w"))).alias(f"w{i}") for i, (c, e) in enumerate(models)]
    wide = weights.groupBy("f").agg(*own)
    product = df.join(maybe_broadcast(wide, weight_rows), "f")
    terms = product.select("row_id", *[(F.col("v") * F.coalesce(f"w{i}", F.lit(0.0))).alias(f"p{i}") for i in range(len(models))])
    zeros = rows.select("row_id", *[F.lit(0.0).alias(f"p{i}") for i in range(len(models))])
    summed = terms.unionByName(zeros).groupBy("row_id").agg(*[F.sum(f"p{i}").alias(f"z{i}") for i in range(len(models))])
    each = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(e).alias("epoch"), F.col(f"z{i}").alias("z")) for i, (c, e) in enumerate(models)])
    return summed.select("row_id", F.inline(each)).select("class", "epoch", "row_id", "z")


def _right(prediction: Column) -> Column:
    return F.avg((prediction == F.col("label")).cast("double")).alias("accuracy")


def activation(z: Column, sigmoid: str | None) -> Column:
    """The curve a model was trained with; the logistic one without a name."""
    return logistic(z) if sigmoid is None else approx_sigmoid(z, sigmoid)


def score_epochs(
    df: DataFrame, y: DataFrame, weights: DataFrame, weight_rows: int | None = None, cut: float = 0.5, sigmoid: str | None = None
) -> DataFrame:
    """(epoch, accuracy) of a two-class model; an epoch that was not stored is not scored."""
    scores = epoch_scores(df, y.select("row_id"), weights, weight_rows)
    guess = threshold(activation(F.col("z"), sigmoid), cut, 0)
    return scores.join(y, "row_id").groupBy("epoch").agg(_right(guess))


def ovr_predict(scores: DataFrame, sigmoid: str | None = None) -> DataFrame:
    """(epoch, row_id, prediction): class of highest score, or of highest activation, the first class on ties."""
    worth = F.col("z") if sigmoid is None else approx_sigmoid(F.col("z"), sigmoid)
    best = F.max(F.struct(worth.alias("z"), (-F.col("class")).alias("back"))).alias("b")
    return scores.groupBy("epoch", "row_id").agg(best).select("epoch", "row_id", (-F.col("b.back")).alias("prediction"))


def score_epochs_ovr(df: DataFrame, y: DataFrame, weights: DataFrame, weight_rows: int | None = None, sigmoid: str | None = None) -> DataFrame:
    """(epoch, accuracy) of a one-vs-rest model."""
    predicted = ovr_predict(epoch_scores(df, y.select("row_id"), weights, weight_rows), sigmoid)
    return predicted.join(y, "row_id").groupBy("epoch").agg(_right(F.col("prediction")))


def epochs_of(model: MinibatchModel, x: DataFrame, y: DataFrame, classes: list[int] | None = None, sigmoid: str | None = None, width: int | None = None) -> DataFrame:
    """(epoch, accuracy, best) of a trained model on the rows of ``y``, held out or not; of equal accuracies the first epoch is best.

    Two classes without a list of them are told apart by one model and a threshold, several by the highest activation.
    """
    score = score_epochs_ovr if classes else score_epochs
    scored = write_out(score(x, y, model.weights, width, sigmoid=sigmoid), "accuracies")
    best = best_epoch(scored).select(F.col("epoch").alias("_best"))
    return scored.join(F.broadcast(best), F.col("epoch") == F.col("_best"), "left").select("epoch", "accuracy", F.col("_best").isNotNull().alias("best"))


def train_best_epoch(
    run: str, x: DataFrame, y: DataFrame, x_test: DataFrame, y_test: DataFrame, cfg: MinibatchConfig, classes: list[int] | None = None, **options: object
) -> tuple[MinibatchModel, DataFrame]:
    """Train one model a class in the folder ``run``, or go on there, and score every epoch on held-out rows."""
    model = train_run(run, x, y, cfg, classes, **options)
    return model, epochs_of(model, x_test, y_test, classes, cfg.sigmoid, max(len(classes or [1]), 1) * cfg.epochs * cfg.width)
