"""Operators that learn from labels: exact search, held-out accuracy, defined cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sketchframe.llm import quality, toxicity
from sketchframe.llm.common import learnable
from sketchframe.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def corpus(n=600, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.25, rng.random() < 0.7
        text = [rng.choice(words) for _ in range(rng.randrange(10, 80))]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["jerk", "moronic", "moronisch", "crud"]))
        if not good:
            text = [w + rng.choice(["%%", "!!"]) for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, documents):
    rows, labels = corpus()
    rows += [(9000, None), (9001, ""), (9002, "jerk"), (3, rows[3][1]), (None, rows[4][1]), (9003, "jerk " * 30_000)]
    labels += [(1, None, None), (None, 1, 1), (2, labels[2][1], labels[2][2]), (99_999, 1, 1)]
    return documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), dict(corpus()[1][i][::2] for i in range(600))


def test_search_is_exact():
    rng = np.random.default_rng(0)

    def unit(n):
        made = np.where(rng.random((n, 40)) < 0.1, rng.random((n, 40)), 0.0)
        norm = np.sqrt((made * made).sum(axis=1, keepdims=True))
        return np.divide(made, norm, out=made, where=norm > 0)

    examples, queries = unit(700), unit(90)
    best, found = toxicity.BlockMaxIndex(examples, 16).search(queries, 7)
    full = np.round(queries @ examples.T, 9)
    assert np.array_equal(best, -np.sort(-full, axis=1)[:, :7])
    for q in range(len(queries)):
        assert np.array_equal(full[q, found[q][found[q] >= 0]], best[q][found[q] >= 0])
        assert (best[q][found[q] < 0] == 0).all()
    left, names = toxicity.BlockMaxIndex(examples, 16).search(examples, 5, leave=np.arange(len(examples)))
    assert not (names == np.arange(len(examples))[:, None]).any()
    inner = np.round(examples @ examples.T, 9)
    np.fill_diagonal(inner, 0)
    assert np.array_equal(left, -np.sort(-inner, axis=1)[:, :5])


def test_empty_index_and_queries():
    best, found = toxicity.BlockMaxIndex(np.zeros((0, 4))).search(np.ones((2, 4)), 3)
    assert not best.any() and (found == -1).all()
    assert toxicity.BlockMaxIndex(np.eye(4)).search(np.zeros((0, 4)), 3)[0].shape == (0, 3)


def test_toxicity(tables):
    docs, labels, truth = tables
    held, learn = learnable(5, 0)
    model = toxicity.fit(docs, labels, learn)
    rows = toxicity.score(docs, model, held).collect()
    assert len(rows) == docs.count()
    by_id = {}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and len(r.neighbours) == len(r.cosines)
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by_id.values())
    assert by_id[None] == by_id[4] and by_id[9000] == by_id[9001]
    assert min(by_id[9002]) >= 0.5 and min(by_id[9003]) >= 0.5
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(min(by_id[i]) >= 0.5) == truth[i] for i in out])
    assert right >= 0.97
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in rows if not r.predicted), key=str)


def test_quality(tables):
    docs, labels, _ = tables
    truth = {i: q for i, q, _ in corpus()[1]}
    held, learn = learnable(4, 2)
    rows = quality.score(docs, quality.fit(docs, labels, learn), held).collect()
    by_id = {}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        by_id.setdefault(r.doc_id, set()).add(round(r.score, 9))
    assert by_id[None] == by_id[4] and by_id[9000] == by_id[9001]
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(min(by_id[i]) >= 0.7) == truth[i] for i in out]) >= 0.95


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_without_labels_or_documents(spark, documents, operator):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    docs = documents([(1, "a b c"), (2, None)])
    _, learn = learnable(5, 0)
    assert {round(r.score, 6) for r in operator.score(docs, operator.fit(docs, none, learn)).collect()} == {0.5}
    assert len({r.score for r in operator.score(docs, operator.fit(docs, one, learn)).collect()}) == 1
    assert operator.score(documents([]), operator.fit(documents([]), one, learn)).count() == 0


def test_vectors_do_not_depend_on_the_cut():
    texts = pa.array(["a bc %% D e", "", "x y z " * 50, "Q1 q2"])
    whole = quality.features(np.random.default_rng(1).random((1 << quality.BUCKET_BITS, quality.DIMENSIONS)).astype(np.float32), texts)
    parts = [quality.features(np.random.default_rng(1).random((1 << quality.BUCKET_BITS, quality.DIMENSIONS)).astype(np.float32), texts.slice(i, 1)) for i in range(4)]
    assert np.allclose(whole, np.concatenate(parts))


@pytest.mark.parametrize("name, column, out, least", [("op3_toxicity", "toxic", (5, 0), 0.9), ("op7_quality_classifier", "quality", (4, 2), 0.9)])
def test_query_on_held_out_rows(spark, name, column, out, least):
    got = QUERIES[name](spark, SMALL).toPandas()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert len(both) > 50 and (both.predicted == both[column]).mean() >= least
