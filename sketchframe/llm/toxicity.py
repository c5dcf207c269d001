"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and beginnings of words.  ``fit`` takes a bounded sample of labelled documents
(``per_class`` of each label, those with the least hash of their id), keeps the terms that tell
the labels apart, counts in how many of *all* documents each occurs, and lays the sample out as
an inverted index in blocks of examples.  A block holds, for each of its terms, the largest
weight, which bounds every cosine in the block, and the postings.  ``score`` visits a document's
blocks from the highest bound down and stops when no bound exceeds the k-th best cosine, so the k
largest cosines are exact.  Their distance-weighted votes pass a logistic curve that was fitted on the
examples with each left out of its own vote.

Defined cases: a null or empty text, or one without any kept term, gets the calibrated rate of
such examples.  Without labels, or with one label only, every score is the smoothed share of
toxic labels.  Repeated rows and ties get equal scores, since only the text counts; equal cosines
are settled by the order of the index.  Labels that are null are not used, and of several labels
of one id the largest counts.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchframe.llm.common import bounded_sample, labelled, texts
from sketchframe.llm.text import Flat, flat, lean, salted
from sketchframe.session import write_out

BEGINNINGS = (4, 5, 6)
BLOCK = 64


# --- terms ------------------------------------------------------------------


def terms(piece: Flat) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all words and of the first 4, 5 and 6 bytes of longer ones."""
    parts, rows = [], []
    for size, h, row in piece.words_cut(BEGINNINGS):
        parts.append(salted(h, size))
        rows.append(row)
    return np.concatenate(parts), np.concatenate(rows)


def counted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs and how often each occurs."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


@dataclass
class Vocabulary:
    """Kept terms in order of their hash; a table of leading bits turns most others away."""

    hashes: np.ndarray

    def __post_init__(self) -> None:
        self.near = np.zeros(1 << 16, bool)
        self.near[self.hashes >> np.uint64(48)] = True

    def count(self, piece: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, occurrences) of the kept terms of some texts."""
        h, row = terms(piece)
        if not len(self.hashes):
            return row[:0], row[:0], row[:0]
        seen = self.near[h >> np.uint64(48)]
        h, row = h[seen], row[seen]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = self.hashes[at] == h
        code, n = np.unique(row[found] * len(self.hashes) + at[found], return_counts=True)
        return code // len(self.hashes), code % len(self.hashes), n


# --- index ------------------------------------------------------------------


class BlockMaxIndex:
    """Examples in blocks; per block and term the postings and the largest weight."""

    def __init__(self, weights: np.ndarray, block: int = BLOCK):
        """``weights``: examples by terms, rows of unit length or zero."""
        n, width = weights.shape
        order = np.argsort(-weights, axis=1, kind="stable")[:, :3]
        strongest = [np.where(np.take_along_axis(weights, order[:, i : i + 1], 1)[:, 0] > 0, order[:, i], width) for i in range(order.shape[1])]
        self.order = np.lexsort(strongest[::-1]) if strongest else np.arange(n)
        laid = weights[self.order]
        self.blocks, bounds = [], []
        for start in range(0, n, block):
            part = laid[start : start + block]
            used = np.flatnonzero(part.any(axis=0))
            self.blocks.append((start, used, np.ascontiguousarray(part[:, used].T)))
            bounds.append(part.max(axis=0))
        self.bounds = np.array(bounds).reshape(len(bounds), width)

    def search(self, queries: np.ndarray, k: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k largest positive cosines of each query and their examples (-1: none).

        ``leave`` names one example per query that is not to be found.
        """
        q = len(queries)
        best, found = np.zeros((q, k)), np.full((q, k), -1, np.int64)
        if not self.blocks or not q:
            return best, found
        upper = queries @ self.bounds.T + 1e-9
        visit = np.argsort(-upper, axis=1, kind="stable")
        upper = np.take_along_axis(upper, visit, 1)
        for step in range(len(self.blocks)):
            open_ = np.flatnonzero((upper[:, step] > best[:, -1] + 2e-9) & (upper[:, step] > 2e-9))
            if not len(open_):
                break
            block = visit[open_, step]
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                rows = open_[part]
                start, used, postings = self.blocks[block[part[0]]]
                near = np.round(queries[np.ix_(rows, used)] @ postings, 9)
                names = np.broadcast_to(self.order[start : start + near.shape[1]], near.shape)
                if leave is not None:
                    near = np.where(names == leave[rows, None], 0.0, near)
                better = near.max(axis=1) > best[rows, -1]
                rows, near, names = rows[better], near[better], names[better]
                both = np.concatenate([best[rows], near], axis=1)
                ids = np.concatenate([found[rows], np.where(near > 0, names, -1)], axis=1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                top = np.take_along_axis(top, np.lexsort((top, -np.take_along_axis(both, top, 1)), axis=1), 1)
                best[rows], found[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
        return best, found


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    k: int
    empty: float
    prior: float
    curve: tuple[float, float]

    def vectors(self, row: np.ndarray, term: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
        made = np.zeros((rows, len(self.idf)))
        made[row, term] = (1.0 + np.log(n)) * self.idf[term]
        norm = np.sqrt((made * made).sum(axis=1, keepdims=True))
        return np.divide(made, norm, out=made, where=norm > 0)

    def votes(self, near: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Share of toxic votes; the weight of a vote falls with the distance 1 - cosine.

        One vote of the prior joins them, so that a few distant examples do not decide.
        """
        weight = np.where(found >= 0, self.weights[found] * near * near / (1.05 - near), 0.0) if len(self.weights) else np.zeros(near.shape)
        toxic = (weight * self.labels[found]).sum(axis=1) if len(self.labels) else np.zeros(len(near))
        share = (toxic + self.prior) / (weight.sum(axis=1) + 1.0)
        return np.where((found >= 0).any(axis=1), share, self.empty)

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1.0 / (1.0 + np.exp(-(a * _logit(share) + b)))

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, neighbours, cosines) of each text."""
        n = len(column)
        cosines, found = np.zeros((n, self.k)), np.full((n, self.k), -1, np.int64)
        parts = [(piece.first, *self.vocabulary.count(piece)) for piece in flat(column)]
        if parts:
            row = np.concatenate([first + r for first, r, _, _ in parts])
            term, times = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
            told = np.unique(row)  # only these have a vector
            for start in range(0, len(told), 2048):
                some = told[start : start + 2048]
                a, b = np.searchsorted(row, [some[0], some[-1] + 1])
                made = self.vectors(np.searchsorted(some, row[a:b]), term[a:b], times[a:b], len(some))
                cosines[some], found[some] = self.index.search(made, self.k)
        return self.calibrated(self.votes(cosines, found)), found, cosines


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Weighted logistic curve over logits, by Newton steps with a slight pull to (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * x + b, -35, 35)))
        g = np.array([((p - y) * x * weight).sum() + (a - 1.0), ((p - y) * weight).sum() + b])
        s = weight * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1.0, (s * x).sum()], [(s * x).sum(), s.sum() + 1.0]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


# --- Spark ------------------------------------------------------------------


def _term_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for piece in flat(batch.column("text")):
            row, h, _ = counted(*terms(piece))
            y = label[piece.first + row]
            found, at = np.unique(h, return_inverse=True)
            pos = np.bincount(at, y, len(found)).astype(np.int64)
            all_ = np.bincount(at, minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(pos), pa.array(all_)], ["term", "pos", "n"])


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, column: str = "toxic", per_class: int = 5000, max_terms: int = 512, least_chi2: float = 30.0, k: int = 15
) -> Model:
    """The model as arrays whose size is bounded by ``per_class`` and ``max_terms``."""
    docs = texts(docs)
    known = labelled(labels, column, learn)
    shares = dict(known.groupBy("label").count().collect())
    total = sum(shares.values())
    prior = (shares.get(1, 0) + 0.5) / (total + 1.0)
    sample = write_out(bounded_sample(docs, known, per_class), "examples")
    sums = sample.groupBy("label").agg(F.count("*")).collect()
    rows = {label: n for label, n in sums}
    n1, n0 = float(rows.get(1, 0)), float(rows.get(0, 0))
    tallied = sample.mapInArrow(lean(_term_labels), "term bigint, pos bigint, n bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    a, n = F.col("pos").cast("double"), F.col("n").cast("double")
    cross = a * (F.lit(n0) - (n - a)) - (n - a) * (F.lit(n1) - a)
    below = n * (F.lit(n0 + n1) - n) * F.lit(n1 * n0)
    chi2 = F.when(below > 0, F.lit(n0 + n1) * cross * cross / F.nullif(below, F.lit(0.0))).otherwise(0.0)
    best = tallied.select("term", chi2.alias("chi2")).where(F.col("chi2") >= least_chi2)
    kept = [r.term for r in best.orderBy(F.desc("chi2"), "term").limit(max_terms).collect()]
    vocabulary = Vocabulary(np.sort(np.array(kept, np.int64).view(np.uint64)))

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_, seen = 0, np.zeros(len(vocabulary.hashes), np.int64)
        for batch in batches:
            total_ += batch.num_rows
            for piece in flat(batch.column("text")):
                seen += np.bincount(vocabulary.count(piece)[1], minlength=len(seen))
        codes = np.arange(-1, len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(np.append(total_, seen))], ["term", "n"])

    df = dict(docs.select("text").mapInArrow(lean(document_counts), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())
    idf = np.array([np.log((1.0 + df.get(-1, 0)) / (1.0 + df.get(i, 0))) + 1.0 for i in range(len(vocabulary.hashes))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per_row: list[tuple[list[int], list[int]]] = [([], [])] * batch.num_rows
            for piece in flat(batch.column("text")):
                row, term, times = vocabulary.count(piece)
                cut = np.searchsorted(row, np.arange(piece.n + 1))
                for i in range(piece.n):
                    per_row[piece.first + i] = term[cut[i] : cut[i + 1]].tolist(), times[cut[i] : cut[i + 1]].tolist()
            lists = [pa.array([p[j] for p in per_row], pa.list_(pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], ["doc_id", "label", "term", "n"])

    made = sample.mapInArrow(lean(vectors), "doc_id bigint, label int, term array<bigint>, n array<bigint>")
    examples = made.groupBy("doc_id", "label").agg(F.min(F.struct("term", "n")).alias("v")).orderBy("doc_id").collect()
    ids = np.array([r.doc_id for r in examples], np.int64)
    y = np.array([r.label for r in examples], np.float64)
    share1 = y.mean() if len(y) else 0.5
    weight = np.where(y == 1, prior / max(share1, 1e-9), (1 - prior) / max(1 - share1, 1e-9))
    model = Model(vocabulary, idf, BlockMaxIndex(np.zeros((0, len(idf)))), ids, y, weight, k, prior, prior, (1.0, 0.0))
    row = np.repeat(np.arange(len(examples)), [len(r.v.term) for r in examples])
    term = np.array([t for r in examples for t in r.v.term], np.int64)
    times = np.array([t for r in examples for t in r.v.n], np.float64)
    matrix = model.vectors(row, term, times, len(examples))
    model.index = BlockMaxIndex(matrix)
    bare = ~matrix.any(axis=1)
    model.empty = float(((weight * y)[bare].sum() + prior) / (weight[bare].sum() + 1.0))
    if 0 < y.sum() < len(y):
        near, found = model.index.search(matrix, k, leave=np.arange(len(y)))
        model.curve = fit_curve(_logit(model.votes(near, found)), y, weight)
    return model


SCORED = "score double, predicted int, neighbours array<bigint>, cosines array<double>"


def score(docs: DataFrame, model: Model, held_out: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and, as evidence, the nearest examples with their cosines."""
    held = F.lit(False) if held_out is None else held_out
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            value, found, near = m.score(batch.column("text"))
            has = found >= 0
            offsets = pa.array(np.append(0, np.cumsum(has.sum(axis=1))).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(m.ids[found[has]] if has.any() else np.zeros(0, np.int64)))
            cosines = pa.ListArray.from_arrays(offsets, pa.array(near[has]))
            predicted = pa.array((value >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(value), predicted, ids, cosines],
                ["doc_id", "held_out", "score", "predicted", "neighbours", "cosines"],
            )

    return texts(docs, held.alias("held_out")).mapInArrow(lean(run), f"doc_id bigint, held_out boolean, {SCORED}")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    rows = docs.select(F.struct("*").alias("row"))  # one column, whatever the names inside
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(pc.struct_field(batch.column("row"), [text]))[0] < threshold))

    return rows.mapInArrow(lean(run), rows.schema).select("row.*")
