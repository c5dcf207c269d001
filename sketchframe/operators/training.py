"""Mini-batch training whose state is a table, so that a lost driver goes on where it stopped.

A run is a folder below the shared one:

* ``batches-*/folder=k`` holds the rows of some consecutive batches, each row packed as one list.  A step reads the folder
  of its batch and no other, so its plan lists one folder however many there are.
* Batches of up to ``TASK_ROWS`` rows are learned one after another in one task, a stretch of at most ``FOLDER_ROWS`` rows
  of one folder at a time; the task holds one batch and the weights.  A job thus ends a folder, not a batch.  Each step of
  larger batches is a job of its own, with as many tasks as the batch has pieces.
* ``layout`` is one row: what the run was started with and which batch folder is its own.  It is written last, in
  one file, so a run either has a whole batch store or none.
* ``state/step=n`` holds the weights and losses after n steps, in one file that appears by a single rename.  A run
  goes on from the greatest one.

Every sum over a batch is added in an order of its own (that of its rows, or ``task_sums``), so a run that was interrupted ends with the same
weights, bit for bit, as one that was not.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchframe.functions.hashing import stream_key
from sketchframe.functions.numeric import approx_sigmoid, taylor_term
from sketchframe.operators.gather import task_sums
from sketchframe.operators.reshape import batch_rows
from sketchframe.session import BROADCAST_ROWS, write_out

WEIGHTS = "class int, f bigint, w double"
STORED = "batch bigint, row_id bigint, label int, f array<int>, v array<double>"
STATE = "class int, epoch int, active boolean, total double, previous double, loss double, status string, f bigint, w double"
FOLDER_ROWS = 100_000
TASK_ROWS = 10_000


@dataclass(frozen=True)
class MinibatchConfig:
    """Step w <- w - penalty * alpha * g - lam * alpha * w / B, with g = X'e / B."""

    batch_size: int
    width: int
    alpha: float = 0.1
    lam: float = 0.0
    penalty: float = 1.0
    epochs: int = 5
    sigmoid: str = "linear"
    eps: float = 1e-5
    stop_on_converge: bool = True
    stop_on_overflow: bool = False
    loss_on: str = "score"


@dataclass(frozen=True)
class MinibatchModel:
    """Weights W(class, epoch, f, w) after each epoch and the loss of each epoch."""

    weights: DataFrame
    metrics: DataFrame


# --- batches ----------------------------------------------------------------


@dataclass(frozen=True)
class BatchStore:
    """Rows laid out by batch; ``m`` rows in batches of ``batch_size``, ``per_folder`` of them in a folder."""

    path: str
    m: int
    batch_size: int
    per_folder: int

    @property
    def batches(self) -> int:
        return -(-self.m // self.batch_size)

    def size(self, batch: int) -> int:
        return min(self.batch_size, self.m - batch * self.batch_size)

    def read(self, spark: SparkSession, batch: int) -> DataFrame:
        """(label, f, v) of one batch, from its own folder."""
        folder = f"{self.path}/folder={batch // self.per_folder}"
        rows = spark.read.schema(STORED).parquet(folder)
        return rows.where(F.col("batch") == batch).select("label", "f", "v")

    def read_stretch(self, spark: SparkSession, batches: list[int]) -> DataFrame:
        """(place, label, f, v) of batches of one folder in one partition, by their place in the list, then in row order."""
        rows = spark.read.schema(STORED).parquet(f"{self.path}/folder={batches[0] // self.per_folder}")
        first, last = min(batches), max(batches)
        rows = rows.where(F.col("batch").between(first, last))
        if batches == list(range(first, last + 1)):
            rows = rows.withColumn("place", (F.col("batch") - first).cast("int"))
        else:
            places = spark.createDataFrame(list(zip(batches, range(len(batches)), strict=True)), "batch bigint, place int")
            rows = rows.join(F.broadcast(places), "batch")  # a row per batch of a folder
        return rows.coalesce(1).sortWithinPartitions("place", "row_id", "label", "f", "v").select("place", "label", "f", "v")

    def stretch(self, order: list[int], place: int, step: int, every: int | None) -> list[int]:
        """The batches from ``place`` on that a task takes at once: of one folder, up to the next commit."""
        most = FOLDER_ROWS // self.batch_size if self.batch_size <= TASK_ROWS else 1
        end = place + 1
        while end < len(order) and end - place < most and not (every and (step + end - place) % every == 0):
            if order[end] // self.per_folder != order[place] // self.per_folder:
                break
            end += 1
        return order[place:end]

    def order(self, epoch: int, seed: int | None) -> list[int]:
        """The batches of an epoch, as stored without a seed, else as a permutation: folders are dealt, then their batches."""
        if seed is None:
            return list(range(self.batches))
        rng = np.random.default_rng([stream_key(seed, "epoch order") % 2**63, epoch])
        folders = rng.permutation(-(-self.batches // self.per_folder))
        spans = [range(k * self.per_folder, min((k + 1) * self.per_folder, self.batches)) for k in folders.tolist()]
        return [int(b) for span in spans for b in rng.permutation(list(span))]


def store_batches(x: DataFrame, y: DataFrame, batch_size: int, path: str, per_folder: int | None = None) -> BatchStore:
    """Lay rows out by batch, in row order; a row without cells is stored too."""
    per_folder = per_folder or max(1, FOLDER_ROWS // batch_size)
    batches = write_out(batch_rows(y.select("row_id"), batch_size), "batches")
    packed = x.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(F.col("f").cast("int").alias("f"), "v"))).alias("cells"))
    labels = y.select("row_id", F.col("label").cast("int").alias("label")).join(batches, "row_id")
    rows = labels.join(packed, "row_id", "left").select(
        F.expr(f"batch div {per_folder}").alias("folder"), "batch", "row_id", "label",
        F.coalesce("cells.f", F.array().cast("array<int>")).alias("f"), F.coalesce("cells.v", F.array().cast("array<double>")).alias("v"),
    )
    # rows of a batch are stored in their own order, so that two stores of the same rows give the same sums
    rows.repartition("folder").sortWithinPartitions("folder", "batch", "row_id").write.partitionBy("folder").parquet(path)
    return BatchStore(path, batches.count(), batch_size, per_folder)


# --- state ------------------------------------------------------------------


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table of a run; None if it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class _State:
    """Weights of every class, whether it still learns, and its losses."""

    def __init__(self, classes: list[int], width: int):
        self.weights = {c: np.zeros(width) for c in classes}
        self.active = dict.fromkeys(classes, True)
        self.total = dict.fromkeys(classes, 0.0)
        self.previous: dict[int, float | None] = dict.fromkeys(classes)
        self.closed: dict[int, tuple[float, str]] = {}  # loss and status of the epoch that this state ends

    def table(self, epoch: int) -> pd.DataFrame:
        parts = []
        for c, w in self.weights.items():
            loss, status = self.closed.get(c, (None, None))
            head = {"class": c, "epoch": epoch, "active": self.active[c], "total": self.total[c], "previous": self.previous[c], "loss": loss, "status": status}
            f = w.nonzero()[0]
            for part in (pd.DataFrame([{**head, "f": -1, "w": 0.0}]), pd.DataFrame({"class": c, "epoch": epoch, "f": f, "w": w[f]})):
                parts.append(part.reindex(columns=[c.split()[0] for c in STATE.split(", ")]).astype(object))
        return pd.concat(parts).astype(object).where(lambda d: d.notna(), None)

    def load(self, rows: list) -> None:
        for r in rows:
            if r["f"] < 0:
                c = r["class"]
                self.active[c], self.total[c], self.previous[c] = r["active"], r["total"], r["previous"]
            else:
                self.weights[r["class"]][r["f"]] = r["w"]


def _gradients(weights: dict[int, np.ndarray], cfg: MinibatchConfig, size: int):
    """Per class the gradient and, behind it, the loss of a batch."""

    def partial(frames: Iterator[pa.RecordBatch]) -> np.ndarray:
        made = np.zeros((len(weights), cfg.width + 1))
        for frame in frames:
            lists = frame.column("f")
            f, v = (frame.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("f", "v"))
            row = np.repeat(np.arange(frame.num_rows), np.diff(lists.offsets.to_numpy()))
            label = frame.column("label").to_numpy(zero_copy_only=False)
            for i, (c, w) in enumerate(weights.items()):
                z = np.bincount(row, v * w[f], minlength=frame.num_rows)
                target = (label == c).astype(float)
                guess = approx_sigmoid(z, cfg.sigmoid)
                made[i, :-1] += np.bincount(f, v * ((guess - target) / size)[row], minlength=cfg.width)
                made[i, -1] += taylor_term(guess if cfg.loss_on == "prob" else z, target, np.full(len(z), float(size))).sum()
        return made.ravel()

    return partial


def _steps(weights: dict[int, np.ndarray], totals: dict[int, float], cfg: MinibatchConfig, sizes: list[int]):
    """Per class the weights and the loss so far after the batches of a stretch, whose rows come in the order of their places."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, done, held = dict(weights), dict(totals), 0, []

        def end() -> None:
            """Learn from the rows held, which are all of the batch at place ``done``."""
            nonlocal now, total, done
            whole = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
            made = _gradients(now, cfg, sizes[done])(whole).reshape(len(now), cfg.width + 1)
            now, total = _moved(now, total, made, cfg, sizes[done])
            held.clear()
            done += 1

        for frame in frames:
            place = frame.column("place").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            for start, stop in zip(cuts, cuts[1:]):  # noqa: B905
                while start < stop and done < place[start]:
                    end()
                if start < stop:
                    held.append(frame.slice(start, stop - start))
        while done < len(sizes):
            end()
        parts = [np.append(w, total[c]).tobytes() for c, w in now.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(now), pa.int32()), pa.array(parts, pa.binary())], ["class", "part"])

    return run


def _moved(weights: dict[int, np.ndarray], totals: dict[int, float], made: np.ndarray, cfg: MinibatchConfig, size: int) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """Weights and losses after a step with the gradients and losses ``made``."""
    decay = 1.0 - cfg.lam * cfg.alpha / size
    moved = {c: w * decay - cfg.penalty * cfg.alpha * row[:-1] for (c, w), row in zip(weights.items(), made, strict=True)}
    return moved, {c: totals[c] + float(row[-1]) for c, row in zip(weights, made, strict=True)}


def _layout(run: str, x: DataFrame, y: DataFrame, cfg: MinibatchConfig, classes: list[int], seed: int | None, per_folder: int | None) -> BatchStore:
    """The batch store of a run, made if the run is new; a run that was started otherwise is an error."""
    spark = x.sparkSession
    started = json.dumps({**asdict(cfg), "classes": classes, "seed": seed}, sort_keys=True)
    schema = "path string, m bigint, batch_size int, per_folder int, started string"
    known = _read(spark, f"{run}/layout", schema)
    row = known.first() if known is not None else None
    if row is None:
        low, high = x.agg(F.min("f"), F.max("f")).first()
        if low is not None and (low < 0 or high >= cfg.width):
            raise ValueError(f"features {low} to {high} do not fit a width of {cfg.width}")
        name = f"batches-{uuid.uuid4().hex}"
        store = store_batches(x, y, cfg.batch_size, os.path.join(run, name), per_folder)
        made = spark.createDataFrame([(name, store.m, store.batch_size, store.per_folder, started)], schema)
        made.coalesce(1).write.mode("overwrite").parquet(f"{run}/layout")
        return store
    if row["started"] != started:
        raise ValueError(f"the run in {run} was started with {row['started']}, not {started}")
    return BatchStore(os.path.join(run, row["path"]), row["m"], row["batch_size"], row["per_folder"])


def train_run(
    run: str,
    x: DataFrame,
    y: DataFrame,
    cfg: MinibatchConfig,
    classes: list[int] | None = None,
    seed: int | None = None,
    every: int | None = None,
    per_folder: int | None = None,
    watch: Callable[[int], None] | None = None,
) -> MinibatchModel:
    """Train in the folder ``run``, or go on with what is there; all one-vs-rest classes share each pass.

    Without ``classes`` the labels are 0 and 1.  ``seed`` deals the batches anew in every epoch.  The state is written after
    every epoch and after every ``every`` steps; ``watch`` is called with the number of each step done.  The weights are arrays of
    the driver and go out with each step, so classes times width is bounded by ``BROADCAST_ROWS``.
    """
    spark = x.sparkSession
    classes = sorted(classes or [1])
    if len(classes) * cfg.width > BROADCAST_ROWS:
        raise ValueError(f"{len(classes)} classes of width {cfg.width} are too large to pack; use packed=False")
    store = _layout(run, x, y, cfg, classes, seed, per_folder)
    state, step = _State(classes, cfg.width), 0
    stored = _read(spark, f"{run}/state", f"{STATE}, step bigint")
    if stored is not None:
        last = stored.agg(F.max("step")).first()[0]
        if last is not None:
            state.load(stored.where(F.col("step") == last).collect())  # classes * (width + 1) rows at most
            step = last

    def commit(epoch: int) -> None:
        table = spark.createDataFrame(state.table(epoch), STATE)
        table.coalesce(1).write.mode("overwrite").parquet(f"{run}/state/step={step}")

    n = store.batches
    while step < n * cfg.epochs and any(state.active.values()):
        epoch = step // n + 1
        order = store.order(epoch, seed)
        place = step % n
        while place < n:
            active = {c: w for c, w in state.weights.items() if state.active[c]}
            totals = {c: state.total[c] for c in active}
            batches = store.stretch(order, place, step, every)
            sizes = [store.size(b) for b in batches]
            if store.batch_size <= TASK_ROWS:
                rows = store.read_stretch(spark, batches).mapInArrow(_steps(active, totals, cfg, sizes), "class int, part binary")
                parts = {r["class"]: np.frombuffer(r["part"]) for r in rows.collect()}  # a row per class
                moved, totals = {c: p[:-1] for c, p in parts.items()}, {c: float(p[-1]) for c, p in parts.items()}
            else:
                made = task_sums(store.read(spark, batches[0]), _gradients(active, cfg, sizes[0])).reshape(len(active), cfg.width + 1)
                moved, totals = _moved(active, totals, made, cfg, sizes[0])
            for _ in batches[1:]:
                step += 1
                if watch:
                    watch(step)
            state.weights.update({c: w.copy() for c, w in moved.items()})
            state.total.update(totals)
            step, place = step + 1, place + len(batches)
            state.closed = {}
            if place == n:
                _close(state, cfg, store.m)
            if place == n or (every and step % every == 0):
                commit(epoch)
            if watch:
                watch(step)
    return _model(spark, run, n)


def _close(state: _State, cfg: MinibatchConfig, m: int) -> None:
    """End an epoch: log the losses and stop the classes that are done."""
    for c, learns in list(state.active.items()):
        if not learns:
            continue
        loss, before = state.total[c] / m, state.previous[c]
        overflow = not loss < 1e5
        converged = before is not None and abs(before - loss) < cfg.eps
        state.closed[c] = loss, "NaN" if overflow else "converged" if converged else "ok"
        state.previous[c], state.total[c] = loss, 0.0
        state.active[c] = not ((converged and cfg.stop_on_converge) or (overflow and cfg.stop_on_overflow))


def _model(spark: SparkSession, run: str, batches: int) -> MinibatchModel:
    """Every epoch's end as stored; a class that stopped keeps its weights in later epochs."""
    stored = _read(spark, f"{run}/state", f"{STATE}, step bigint")
    if stored is None:
        return MinibatchModel(spark.createDataFrame([], "class int, epoch int, f bigint, w double"), spark.createDataFrame([], "class int, epoch int, loss double, status string"))
    ends = stored.where(F.col("step") == F.col("epoch").cast("bigint") * batches)
    metrics = ends.where("f < 0 and status is not null").select("class", "epoch", "loss", "status")
    return MinibatchModel(ends.where("f >= 0").select("class", "epoch", "f", "w"), metrics)
