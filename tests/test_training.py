import random

import numpy as np
import pytest

from sketchframe.operators import linear, training
from sketchframe.session import fresh_path

rng = random.Random(11)


class Lost(Exception):
    """Stands for a driver that goes away."""


def tables(spark, m=47, n=5, classes=3):
    draws = np.random.default_rng(4)
    x = np.where(draws.random((m, n)) < 0.6, np.round(draws.normal(size=(m, n)), 2), 0.0)
    x[7] = 0.0  # a row without cells
    y = draws.integers(0, classes, m)
    cells = [(10 * i, f, float(v)) for i, row in enumerate(x) for f, v in enumerate(row) if v]
    frames = spark.createDataFrame(cells, "row_id bigint, f bigint, v double"), spark.createDataFrame([(10 * i, int(c)) for i, c in enumerate(y)], "row_id bigint, label int")
    return x, y, frames


def weights(model):
    return {(r["class"], r["epoch"], r["f"]): r["w"] for r in model.weights.collect()}


CFG = linear.MinibatchConfig(batch_size=10, width=5, alpha=0.7, lam=0.2, epochs=3, stop_on_converge=False)


@pytest.mark.parametrize("seed", [None, 3])
def test_a_run_that_is_lost_goes_on(spark, seed):
    """Stopped after random steps, twice, it ends with the same bits as a run that was not."""
    _, _, (x, y) = tables(spark)
    options = {"classes": [0, 1, 2], "seed": seed, "per_folder": 2}
    whole = training.train_run(fresh_path(spark, "run"), x, y, CFG, **options)
    run = fresh_path(spark, "run")
    done = []
    for stop in sorted(rng.sample(range(1, 15), 2)):

        def watch(step, stop=stop):
            done.append(step)
            if step == stop:
                raise Lost

        with pytest.raises(Lost):
            training.train_run(run, x, y, CFG, every=rng.choice([1, 2]), watch=watch, **options)
    resumed = training.train_run(run, x, y, CFG, watch=done.append, **options)
    assert weights(resumed) == weights(whole)
    assert sorted(map(tuple, resumed.metrics.collect())) == sorted(map(tuple, whole.metrics.collect()))
    assert len(done) < 2 * 15 and done[-1] == 15  # what was committed is not done again
    again = training.train_run(run, x, y, CFG, watch=lambda step: pytest.fail("a finished run has no steps left"), **options)
    assert weights(again) == weights(whole)


def test_a_run_without_a_layout_starts_anew(spark):
    """Batches that were written before the layout belong to no run."""
    _, _, (x, y) = tables(spark)
    run = fresh_path(spark, "run")
    training.store_batches(x.where("row_id < 100"), y.where("row_id < 100"), 10, f"{run}/batches-half")
    whole = training.train_run(fresh_path(spark, "run"), x, y, CFG, [0, 1, 2])
    assert weights(training.train_run(run, x, y, CFG, [0, 1, 2])) == weights(whole)


def test_a_run_keeps_its_settings(spark):
    _, _, (x, y) = tables(spark)
    run = fresh_path(spark, "run")
    training.train_run(run, x, y, CFG, [0, 1])
    with pytest.raises(ValueError, match="was started with"):
        training.train_run(run, x, y, CFG, [0, 1, 2])


def test_a_step_reads_one_folder(spark):
    _, _, (x, y) = tables(spark)
    path = fresh_path(spark, "batches")
    store = training.store_batches(x, y, 5, path, per_folder=3)
    assert (store.m, store.batches, store.size(9)) == (47, 10, 2)
    seen = []
    for batch in range(store.batches):
        rows = store.read(spark, batch)
        assert {f.rsplit("/", 2)[-2] for f in rows.inputFiles()} == {f"folder={batch // 3}"}
        assert rows.count() == store.size(batch)
        seen += [(r.label, tuple(r.f), tuple(r.v)) for r in rows.collect()]
    assert len(seen) == 47 and ((), ()) in {s[1:] for s in seen}


def test_small_batches_share_a_job(spark):
    """A task learns from all batches of a folder, so an epoch takes a job a folder and not one a batch."""
    _, _, (x, y) = tables(spark)
    context, counts = spark.sparkContext, []
    for batch_size in (12, 2):
        cfg = linear.MinibatchConfig(batch_size=batch_size, width=5, epochs=2, stop_on_converge=False)
        context.setJobGroup(f"batches of {batch_size}", "")
        training.train_run(fresh_path(spark, "run"), x, y, cfg, [0, 1, 2])
        counts.append(len(context.statusTracker().getJobIdsForGroup(f"batches of {batch_size}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 2


@pytest.mark.parametrize("seed", [None, 5])
def test_a_stretch_equals_single_steps(spark, seed, monkeypatch):
    """Whole folders in one task, and batches cut by an Arrow batch's end, give the bits of a step a job."""
    _, _, (x, y) = tables(spark)
    made = []
    for every, arrow in ((None, "10000"), (1, "10000"), (None, "7")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
        model = training.train_run(fresh_path(spark, "run"), x, y, CFG, [0, 1, 2], seed=seed, every=every)
        made.append((weights(model), sorted(map(tuple, model.metrics.collect()))))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made[0] == made[1] == made[2]
    monkeypatch.setattr(training, "TASK_ROWS", 0)
    apart = training.train_run(fresh_path(spark, "run"), x, y, CFG, [0, 1, 2], seed=seed)
    assert weights(apart) == pytest.approx(made[0][0])


def test_an_epoch_is_a_permutation_of_folders():
    store = training.BatchStore("x", 95, 10, 3)
    assert store.order(1, None) == list(range(10))
    orders = [store.order(e, 7) for e in (1, 2, 3)]
    assert all(sorted(o) == list(range(10)) for o in orders) and len(set(map(tuple, orders))) > 1
    assert orders[0] == store.order(1, 7) != store.order(1, 8)
    for o in orders:
        folders = [b // 3 for b in o]
        assert [f for i, f in enumerate(folders) if i == 0 or folders[i - 1] != f] == list(dict.fromkeys(folders))


def test_best_epoch_of_several_classes(spark):
    """Weights, accuracies and the best epoch against a plain loop, on rows that were held out."""
    x, y, (cells, labels) = tables(spark)
    learn, held = labels.where("row_id % 30 <> 0"), labels.where("row_id % 30 = 0")
    run = fresh_path(spark, "run")
    model, epochs = linear.train_best_epoch(run, cells.join(learn.select("row_id"), "row_id"), learn, cells.join(held.select("row_id"), "row_id"), held, CFG, [0, 1, 2])
    mine = [i for i in range(len(y)) if i % 3]
    w, want = {c: np.zeros(5) for c in range(3)}, {}
    for epoch in (1, 2, 3):
        for start in range(0, len(mine), 10):
            rows = mine[start : start + 10]
            for c in w:
                e = (0.25 * x[rows] @ w[c] + 0.5 - (y[rows] == c)) / len(rows)
                w[c] = w[c] * (1 - 0.2 * 0.7 / len(rows)) - 0.7 * x[rows].T @ e
        z = np.stack([x[::3] @ w[c] for c in range(3)], axis=1)
        want[epoch] = float((z.argmax(axis=1) == y[::3]).mean())
    got = {r.epoch: (r.accuracy, r.best) for r in epochs.collect()}
    assert {e: a for e, (a, _) in got.items()} == pytest.approx(want)
    first = max(want, key=lambda e: (want[e], -e))
    assert [e for e, (_, best) in got.items() if best] == [first]
    assert {k: v for k, v in weights(model).items() if k[1] == 3} == pytest.approx({(c, 3, f): w[c][f] for c in w for f in range(5)})


def test_a_class_that_stops_keeps_its_weights(spark):
    _, _, (x, y) = tables(spark)
    y = y.where("label < 2")  # class 2 has no row and settles first
    cfg = linear.MinibatchConfig(batch_size=47, width=5, alpha=0.5, epochs=8, eps=1e-4)
    model = training.train_run(fresh_path(spark, "run"), x, y, cfg, [0, 1, 2])
    log = {}
    for r in model.metrics.collect():
        log.setdefault(r["class"], {})[r.epoch] = r.status
    last = {c: max(e) for c, e in log.items()}
    assert all(log[c][last[c]] == "converged" for c in log) and len(set(last.values())) > 1
    got = weights(model)
    for c, e in last.items():
        for later in range(e, max(last.values()) + 1):
            assert all(got[c, later, f] == got[c, e, f] for f in range(5))


def test_no_rows(spark):
    _, _, (x, y) = tables(spark)
    model = training.train_run(fresh_path(spark, "run"), x.where("false"), y.where("false"), CFG, [0, 1])
    assert model.weights.count() == model.metrics.count() == 0


def test_nan_is_the_negative_class(spark):
    from pyspark.sql import functions as F

    from sketchframe.functions.numeric import threshold

    made = spark.createDataFrame([(float("nan"),), (0.5,), (0.4,)], "p double").select(threshold(F.col("p"), 0.5, -1).alias("c"))
    assert [r.c for r in made.collect()] == [-1, 1, -1]


def test_more_models_than_columns_at_once(spark, cells):
    """Models beyond one block are scored too."""
    x = cells({0: {0: 1.0, 1: 2.0}, 1: {1: -1.0}})
    models = [(c, e) for c in range(10) for e in range(9)]
    w = spark.createDataFrame([(c, e, f, float(c + 10 * e + f)) for c, e in models for f in (0, 1)], "class int, epoch int, f bigint, w double")
    got = {(r["class"], r["epoch"], r["row_id"]): r["z"] for r in linear.epoch_scores(x, x.select("row_id").distinct(), w).collect()}
    want = {(c, e, 0): (c + 10 * e) + 2.0 * (c + 10 * e + 1) for c, e in models} | {(c, e, 1): -float(c + 10 * e + 1) for c, e in models}
    assert got == pytest.approx(want)
