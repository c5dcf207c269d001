"""Quality by random indexing: pooled word vectors and a two-layer network with calibrated output.

A token is a run of letters of one case, of digits or of other marks.  Each has a sparse random index vector
that follows from its hash.  One pass over all documents adds, for every token, the index vectors of
the two tokens before and after it to the context vector of its bucket; sums are whole numbers, so they do
not depend on the order.  A document is the average of its tokens' context vectors, where frequent buckets count
less, beside the average of their index vectors and its length.  A network with one hidden layer learns
from a bounded sample of labelled documents (``per_class`` of each label, those with the least hash of their id);
a part of them that it does not learn from sets the temperature of its output.

Defined cases: a null or empty text has zero averages and gets the score the network gives to these.  Without labels, or
with one label only, every score is the smoothed share of label 1.  Repeated rows and ties get equal scores,
since only the text counts.  Null labels are not used; of several labels of one id the largest
counts.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchframe.llm.common import bounded_sample, labelled, texts
from sketchframe.llm.text import Flat, flat, salted
from sketchframe.session import write_out

BUCKET_BITS, DIMENSIONS, NONZERO, REACH = 14, 32, 4, 2
PIECE = 1 << 20


def _index(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (dimension, sign) of each nonzero of the index vectors."""
    for z in range(NONZERO):
        x = salted(h, 11 + z)
        yield (x % np.uint64(DIMENSIONS)).astype(np.int64), np.where(x >> np.uint64(63), 1.0, -1.0)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def contexts(piece: Flat) -> tuple[np.ndarray, np.ndarray]:
    """(sums of index vectors by bucket, tokens by bucket) of some texts."""
    h, row = piece.runs()
    bucket = _bucket(h)
    cells = np.zeros((1 << BUCKET_BITS) * DIMENSIONS)
    for dimension, sign in _index(h):
        for reach in range(1, REACH + 1):
            near = np.flatnonzero(row[reach:] == row[:-reach]) if len(row) > reach else np.zeros(0, np.int64)
            for own, other in ((near, near + reach), (near + reach, near)):
                cells += np.bincount(bucket[own] * DIMENSIONS + dimension[other], sign[other], len(cells))
    return cells, np.bincount(bucket, minlength=1 << BUCKET_BITS)


_COLUMNS = [f"c{i}" for i in range(DIMENSIONS)]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells, n = np.zeros((1 << BUCKET_BITS) * DIMENSIONS), np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for piece in flat(batch.column("text")):
            more = contexts(piece)
            cells += more[0]
            n += more[1]
    used = np.flatnonzero(n)
    wide = np.rint(cells).astype(np.int64).reshape(-1, DIMENSIONS)[used]
    arrays = [pa.array(used), pa.array(n[used]), *(pa.array(np.ascontiguousarray(wide[:, i])) for i in range(DIMENSIONS))]
    yield pa.RecordBatch.from_arrays(arrays, ["bucket", "n", *_COLUMNS])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors by bucket, scaled down for frequent buckets; from all documents."""
    schema = "bucket bigint, n bigint, " + ", ".join(f"{c} bigint" for c in _COLUMNS)
    sums = texts(docs).select("text").mapInArrow(_summed, schema).groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _COLUMNS])
    rows = sums.collect()  # at most 2 ** BUCKET_BITS
    made, n = np.zeros((1 << BUCKET_BITS, DIMENSIONS)), np.zeros(1 << BUCKET_BITS)
    for r in rows:
        made[r[0]], n[r[0]] = r[2:], r[1]
    length = np.sqrt((made * made).sum(axis=1, keepdims=True))
    share = n / max(1.0, n.sum())
    return (np.divide(made, length, out=np.zeros_like(made), where=length > 0) * (1e-3 / (1e-3 + share))[:, None]).astype(np.float32)


def features(vectors: np.ndarray, column: pa.Array) -> np.ndarray:
    """Pooled context and index vectors and the length, one row per text."""
    out = np.zeros((len(column), 2 * DIMENSIONS + 1))
    for piece in flat(column, PIECE):
        h, row = piece.runs()
        n = np.bincount(row, minlength=piece.n)
        at = slice(piece.first, piece.first + piece.n)
        has = n > 0
        mine = out[at]
        if len(h):
            first = (np.cumsum(n) - n)[has]
            mine[has, :DIMENSIONS] = np.add.reduceat(vectors[_bucket(h)], first, axis=0, dtype=np.float64)
            for dimension, sign in _index(h):
                mine[:, DIMENSIONS:-1] += np.bincount(row * DIMENSIONS + dimension, sign, piece.n * DIMENSIONS).reshape(piece.n, -1)
        mine[:, :-1] /= np.maximum(n, 1)[:, None]
        mine[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer of rectified units, one output."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    constant: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0.0) @ w2 + b2[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x) / self.temperature, -35, 35)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 32, epochs: int = 150, batch: int = 256, rate: float = 3e-3, decay: float = 1e-3, seed: int = 7) -> Network:
    """Adam on the weighted logistic loss, then the temperature on a fifth that was held back."""
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    back, learn = order[: len(x) // 5], order[len(x) // 5 :]
    width = x.shape[1]
    net.layers = [rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers], 0
    scaled = (x - net.mean) / net.scale
    for epoch in range(epochs):
        rng.shuffle(learn)
        now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for start in range(0, len(learn), batch):
            at = learn[start : start + batch]
            w1, b1, w2, b2 = net.layers
            inside = scaled[at] @ w1 + b1
            active = np.maximum(inside, 0.0)
            p = 1.0 / (1.0 + np.exp(-np.clip(active @ w2 + b2[0], -35, 35)))
            error = (p - y[at]) * weight[at] / weight[at].sum()
            back1 = np.outer(error, w2) * (inside > 0)
            slopes = [scaled[at].T @ back1 + decay * w1, back1.sum(axis=0), active.T @ error + decay * w2, np.array([error.sum()])]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                net.layers[i] = net.layers[i] - now * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    if len(back):
        z, t, w = net.logit(x[back]), y[back], weight[back]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 101))
        loss = [(w * (np.logaddexp(0, z / g) - t * z / g)).sum() for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network

    def score(self, column: pa.Array) -> np.ndarray:
        return self.network.probability(features(self.vectors, column))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, column: str = "quality", per_class: int = 5000) -> Model:
    """Word vectors from all documents, the network from a bounded sample."""
    docs = texts(docs)
    known = labelled(labels, column, learn)
    shares = dict(known.groupBy("label").count().collect())
    prior = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1.0)
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # 2 ** BUCKET_BITS by DIMENSIONS
    sample = write_out(bounded_sample(docs, known, per_class), "examples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = features(shared.value, batch.column("text"))
            lists = pa.array(list(made), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], ["doc_id", "label", "x"])

    made = sample.mapInArrow(run, "doc_id bigint, label int, x array<double>")
    rows = made.groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
    y = np.array([r.label for r in rows], np.float64)
    if not 0 < y.sum() < len(y):
        return Model(vectors, Network(np.zeros(1), np.ones(1), constant=prior))
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return Model(vectors, train(np.array([r.x for r in rows]), y, weight))


def score(docs: DataFrame, model: Model, held_out: Column | None = None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    held = F.lit(False) if held_out is None else held_out
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = shared.value.score(batch.column("text"))
            predicted = pa.array((value >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(value), predicted], ["doc_id", "held_out", "score", "predicted"]
            )

    return texts(docs, held.alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
