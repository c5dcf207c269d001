import hashlib
import math

import numpy as np
import pytest
from checking import connect, difference

from sketchframe.llm import codes, whitening
from sketchframe.llm.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"
rng = np.random.default_rng(3)


@pytest.fixture(scope="module")
def embeddings(spark):
    """An embeddings table from (vec_id, vector, label), with columns whose names operators use inside."""

    def build(rows):
        plain = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], y) for i, v, y in rows], "vec_id bigint, embedding array<float>, label int")
        return plain.selectExpr("*", "1 as x", "2 as n", "'v' as vector", "'c' as cells", "'d' as code", "3 as error", "4 as component", "5 as _label", "map(1, 2) as m")

    return build


BAD = [(900, None, 1), (901, [1.0, None] + [0.0] * 14, 1), (902, [math.nan] * 16, 2), (903, [math.inf] + [0.0] * 15, None), (904, [0.5] * 7, 1), (905, [], 1)]


def mixed(n=60, width=16):
    rows = [(i, rng.normal(size=width), i % 3 if i % 5 else None) for i in range(n)]
    rows += [(3, rows[3][1], 0), (3, rows[3][1], 0), (None, rows[7][1], 2), (None, rng.normal(size=width), None)]
    return rows + [(200 + i, rows[9][1], 1) for i in range(40)]


# --- whitening --------------------------------------------------------------


def whole(rows):
    return np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v, _ in rows], dtype=object)


def check_whitening(rows, got, width):
    x = whole(rows)
    distinct = np.unique(np.array(x.tolist(), np.int64), axis=0)
    n, sums = len(distinct), [int(s) for s in distinct.sum(axis=0)]
    centre = np.array([[n * int(c) - s for c, s in zip(r, sums)] for r in distinct.tolist()], float) / n
    e, q = np.linalg.eigh(centre.T @ centre / n)
    k = min(16, width)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    assert len(got) == len(rows) * k
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    want_deviation = sorted((i is None, i or 0, sum((n * int(c) - s) ** 2 for c, s in zip(r, sums))) for (i, _, _), r in zip(rows, x) for _ in range(k))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in got) == want_deviation
    trace = np.trace(centre.T @ centre / n)
    for c in range(1, k + 1):
        mine = [r for r in got if r.component == c]
        assert mine[0].explained == pytest.approx(e[c - 1] / trace, rel=1e-9)
        if e[c - 1] < 1e-9 * e[0]:
            assert all(r.whitened is None for r in mine)
            continue
        want = (np.array([[n * int(v) - s for v, s in zip(r, sums)] for r in x], float) / n) @ q[:, c - 1] / np.sqrt(e[c - 1])
        by = {}
        for (i, _, _), w in zip(rows, want):
            by.setdefault(i, []).append(w)
        sign = np.sign(sum(r.whitened * by[r.vec_id][0] for r in mine if len(by[r.vec_id]) == 1))
        mine_by = {}
        for r in mine:
            mine_by.setdefault(r.vec_id, []).append(sign * r.whitened)
        assert all(np.allclose(sorted(by[i]), sorted(mine_by[i]), atol=1e-8) for i in by)
    assert {r.identity_error for r in got}.pop() <= 1e-9


@pytest.mark.parametrize("width", [16, 24, 5])
def test_whitening_against_eigenvectors(embeddings, width):
    rows = mixed(width=width)
    bad = [r for r in BAD if r[1] is None or len(r[1]) != width]
    check_whitening(rows, whitening.whiten(embeddings(rows + bad)).collect(), width)


def test_fewer_rows_than_columns(embeddings):
    """Rank deficiency: components without variance are null and explain nothing."""
    rows = [(i, rng.normal(size=12), 1) for i in range(5)]
    got = whitening.whiten(embeddings(rows)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1, 2, 3, 4}
    assert all(r.explained == 0.0 for r in got if r.component > 4)
    assert {r.identity_error for r in got}.pop() <= 1e-9
    assert sum(r.explained for r in got) == pytest.approx(5.0)


def test_equal_eigenvalues(embeddings):
    """A starting direction sees one component of an eigenspace; the others are found too."""
    rows = [(2 * i + s, [(4.0 if s else -4.0) if j == i else 0.0 for j in range(6)], 0) for i in range(6) for s in (0, 1)]
    got = whitening.whiten(embeddings(rows)).collect()
    assert all(r.explained == pytest.approx(1 / 6) for r in got) and got[0].identity_error <= 1e-9


def test_one_vector_and_none(embeddings):
    got = whitening.whiten(embeddings([(1, [1.0] * 4, 0), (2, [1.0] * 4, 0)])).collect()
    assert len(got) == 8 and all(r.whitened is None and r.n == 1 and r.deviation == 0 and r.explained is None and r.identity_error is None for r in got)
    assert whitening.whiten(embeddings([])).count() == 0
    assert whitening.whiten(embeddings(BAD[:1] + BAD[2:4])).count() == 0


def test_deviation_beyond_a_long(embeddings):
    x = np.array([[5, 7], [6, 9]], np.int64)
    assert whitening.deviations(x, 2, [11, 16]) == [1 + 4, 1 + 4]
    assert whitening.deviations(np.array([[1 << 40], [0]], np.int64), 2, [1 << 40]) == [None, None]
    got = whitening.whiten(embeddings([(1, [1e30, 0.0], 0), (2, [0.0, 0.0], 0)])).collect()
    assert {r.deviation for r in got} == {None}


def test_bidiagonalisation_of_an_ill_conditioned_operator():
    """Left vectors are made again from directions; that must hold for deviations of very different size."""
    x = np.linalg.qr(rng.normal(size=(300, 30)))[0] * np.logspace(0, -6, 30) @ np.linalg.qr(rng.normal(size=(30, 30)))[0]

    def products(left, v):
        t = x @ v
        return (x @ left).T @ t, t @ t, x.T @ t

    found, singular = whitening.bidiagonalise(products, 30, 16, np.linalg.norm(x))
    want = np.linalg.svd(x, compute_uv=False)[:16]
    assert np.allclose(singular, want, rtol=1e-8)
    assert np.allclose(found.T @ found, np.eye(16), atol=1e-12)
    assert np.allclose(np.linalg.norm(x @ found, axis=0), want, rtol=1e-8)


def test_steps_end_early_where_the_wanted_components_stand_out():
    sizes = np.concatenate([np.linspace(100, 50, 4), np.full(196, 1e-9)])
    calls = []

    def products(left, v):
        calls.append(1)
        t = sizes * v
        return (sizes[:, None] * left).T @ t, t @ t, sizes * t

    found, singular = whitening.bidiagonalise(products, 200, 4, np.linalg.norm(sizes))
    assert np.allclose(singular, sizes[:4]) and len(calls) < 40
    assert np.allclose(np.abs(found[:4]), np.eye(4), atol=1e-9)


def test_whitening_of_a_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()]
    check_whitening(rows, QUERIES["op11_embedding_whitening"](spark, ROOT).collect(), 64)


# --- codes ------------------------------------------------------------------


def coded(rows, parts, entries, rounds):
    """The contract, row by row."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([[math.floor(4096 * float(np.float32(c))) for c in v] for _, v, _ in rows], np.int64)
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)
    books = x[:entries].copy()
    for turn in range(rounds + 1):
        code, error = np.zeros((len(x), parts), int), np.zeros(len(x), int)
        for p in range(parts):
            for i, v in enumerate(x[:, p]):
                distance = [int(((v - c) ** 2).sum()) for c in books[:, p]]
                code[i, p] = distance.index(min(distance))
                error[i] += min(distance)
        if turn < rounds:
            for p in range(parts):
                for k in range(len(books)):
                    own = x[code[:, p] == k, p]
                    if len(own):
                        books[k, p] = [int(s) // len(own) for s in own.sum(axis=0)]
    digest = hashlib.sha256(",".join(str(c) for p in range(parts) for b in books[:, p] for c in b).encode()).hexdigest()
    by_label = {}
    for (_, _, y), d in zip(rows, error):
        by_label[y] = by_label.get(y, 0) + int(d)
    return sorted((str(i), "".join(f"{c:02x}" for c in cs), int(d), by_label[y], digest) for (i, _, y), cs, d in zip(rows, code, error))


def result(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize(("width", "parts", "held"), [(16, 8, 1 << 16), (16, 8, 4), (10, 4, 1 << 16), (16, 2, 1)])
def test_codes_against_brute_force(embeddings, width, parts, held):
    rows = mixed(width=width)
    rows[-1:] = [(201, rows[0][1], 1)]
    bad = [r for r in BAD if r[1] is None or len(r[1]) != width]
    got = codes.compress(embeddings(rows + bad), parts=parts, held=held)
    assert result(got) == coded(rows, parts, 16, 6)


def test_ties_and_few_rows(embeddings):
    """Two entries as far from a point: the first is taken; fewer rows than entries."""
    rows = [(1, [0.0] * 8, 0), (2, [1.0] * 8, 0), (3, [0.5] * 8, None), (4, [0.5] * 8, None), (5, [0.0] * 8, 1)]
    assert result(codes.compress(embeddings(rows))) == coded(rows, 8, 16, 6)
    assert result(codes.compress(embeddings(rows), entries=2, rounds=0)) == coded(rows, 8, 2, 0)
    assert codes.compress(embeddings([])).count() == 0
    with pytest.raises(Exception, match="must stay below"):
        codes.compress(embeddings([(1, [1e9] * 8, 0)])).count()


def test_dominated_entries_are_never_nearest():
    """Over all points of a cell, also where hashes of two cells are equal."""
    book = rng.integers(-200, 200, (16, 3))
    points = rng.integers(-400, 400, (5000, 3))
    distance = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    for shift in (2, 4, 6):
        cells = codes.Cells(book)
        cells.shift = shift
        entry, error = cells.nearest(points, True)
        assert (entry == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
        if shift < 6:
            assert cells.maybe.sum(axis=1).mean() < 8  # most entries are dominated in most cells
    cells.places[:] = 10**6  # as if every cell shared its hash with another
    assert cells.candidates(points).all()
    assert (cells.nearest(points, False)[0] == distance.argmin(axis=1)).all()


def test_codes_against_sql(spark):
    name = "op12_vector_codes"
    assert difference(QUERIES[name](spark, ROOT).toPandas(), connect(ROOT).execute(ORACLES[name]).df()) is None
