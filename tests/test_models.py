import math

import numpy as np
import pytest
from conftest import as_dict
from pyspark.errors import PySparkException
from pyspark.ml.linalg import Vectors

from sketchframe.operators import linear, paillier, shares
from sketchframe.queries.sharing import TEST_KEY


def data(m=23, n=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(m, n)) * (rng.random((m, n)) < 0.7)
    return x, (x @ np.arange(1, n + 1) > 0).astype(int)


def frames(spark, x, y):
    cells = [(r, f, float(x[r, f])) for r in range(x.shape[0]) for f in range(x.shape[1]) if x[r, f]]
    return (
        spark.createDataFrame(cells, "row_id bigint, f bigint, v double"),
        spark.createDataFrame(list(enumerate(y.tolist())), "row_id bigint, label int"),
    )


def loop(x, y, cfg, target):
    """The update rule in plain numpy."""
    w, snapshots, losses = np.zeros(x.shape[1]), [], []
    for _ in range(cfg.epochs):
        total = 0.0
        for s in range(0, len(x), cfg.batch_size):
            xb, t = x[s : s + cfg.batch_size], (y[s : s + cfg.batch_size] == target).astype(float)
            b, z = len(xb), xb @ w
            total += ((-z / 2 + t * z - z * z / 8) * (-1 / b) - math.log(0.5)).sum()
            e = 0.25 * z + 0.5 - t
            w = w - cfg.penalty * cfg.alpha * xb.T @ e / b - cfg.lam * cfg.alpha * w / b
        snapshots.append(w)
        losses.append(total / len(x))
    return snapshots, losses


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("classes", [None, [0, 2, 5]])
def test_minibatch_equals_a_plain_loop(spark, packed, classes):
    x, y = data()
    if classes:
        y = np.array([classes[i % 3] for i in range(len(y))])
    cfg = linear.MinibatchConfig(batch_size=9, width=4, alpha=0.4, lam=0.3, penalty=1.5, epochs=2, stop_on_converge=False)
    model = linear.minibatch_lr(*frames(spark, x, y), cfg, classes, packed=packed)
    got = {(r["class"], r["epoch"], r["f"]): r["w"] for r in model.weights.collect()}
    loss = {(r["class"], r["epoch"]): r["loss"] for r in model.metrics.collect()}
    for c in classes or [1]:
        snapshots, losses = loop(x, y, cfg, c)
        for e in (1, 2):
            assert [got[c, e, f] for f in range(4)] == pytest.approx(list(snapshots[e - 1]))
            assert loss[c, e] == pytest.approx(losses[e - 1])


def test_training_stops_when_the_loss_stands_still(spark):
    x, y = data()
    cfg = linear.MinibatchConfig(batch_size=23, width=4, alpha=1e-9, epochs=4)
    model = linear.minibatch_lr(*frames(spark, x, y), cfg)
    assert [(r["epoch"], r["status"]) for r in model.metrics.orderBy("epoch").collect()] == [(1, "ok"), (2, "converged")]
    assert sorted({r["epoch"] for r in model.weights.collect()}) == [1, 2]


def test_solver_reaches_the_optimum(spark, rows_of):
    x, y = data(60, 3, seed=2)
    y[:6] = 1 - y[:6]
    cells, labels = frames(spark, x, y)
    vectors = linear.to_dense_vectors(cells, rows_of(range(60)), 3)
    fitted = linear.train_linear(vectors, labels, C=0.7, tol=1e-10)
    w, signs = np.zeros(3), 2 * y - 1
    for _ in range(50):  # Newton on 1/2 |w|^2 + C sum(loss)
        p = 1 / (1 + np.exp(signs * (x @ w)))
        gradient = w - 0.7 * x.T @ (signs * p)
        hessian = np.eye(3) + 0.7 * x.T @ (x * (p * (1 - p))[:, None])
        w = w - np.linalg.solve(hessian, gradient)
    weights = {r["f"]: r["w"] for r in linear.model_weights(spark, fitted).collect()}
    assert [weights[f] for f in range(3)] == pytest.approx(list(w), abs=1e-4)
    guess = {r["row_id"]: r["prediction"] for r in linear.predict_linear(fitted, vectors).collect()}
    assert guess == {i: int(x[i] @ w > 0) for i in range(60)}


def test_sparse_vectors(spark, rows_of):
    z = spark.createDataFrame([(0, 7, 1), (0, 2, 1), (2, 0, 1)], "row_id bigint, col bigint, v int")
    got = {r["row_id"]: r["features"] for r in linear.to_vectors(z, rows_of(range(3)), 9).collect()}
    assert got == {0: Vectors.sparse(9, {2: 1.0, 7: 1.0}), 1: Vectors.sparse(9, {}), 2: Vectors.sparse(9, {0: 1.0})}
    real = z.selectExpr("row_id", "col", "v / 3.0D as v")
    assert linear.to_vectors(real, rows_of([0]), 9).where("row_id = 0").first()["features"][2] == 1 / 3


def test_one_vs_rest_keeps_the_labels(spark, rows_of):
    x = np.eye(3)[np.arange(30) % 3]
    y = np.array([-1, 4, 9])[np.arange(30) % 3]
    cells, labels = frames(spark, x, y)
    z = cells.withColumnRenamed("f", "col")
    vectors = linear.to_vectors(z, rows_of(range(30)), 3)
    fitted = linear.train_linear(vectors, labels, C=10.0)
    assert {r["row_id"]: r["prediction"] for r in linear.predict_linear(fitted, vectors).collect()} == dict(enumerate(y.tolist()))


def test_scores_ties_and_gaps(spark, cells, rows_of):
    x = cells({0: {0: 1.0}, 1: {1: 1.0}, 2: {}})
    w = spark.createDataFrame([(1, 2, 0, 1.0), (1, 6, 0, -1.0), (3, 2, 1, 2.0), (3, 6, 1, 2.0)], "class int, epoch int, f bigint, w double")
    guess = {(r["epoch"], r["row_id"]): r["prediction"] for r in linear.ovr_predict(linear.epoch_scores(x, rows_of(range(3)), w)).collect()}
    assert guess == {(2, 0): 1, (2, 1): 3, (2, 2): 1, (6, 0): 3, (6, 1): 3, (6, 2): 1}
    y = spark.createDataFrame([(0, 1), (1, 3), (2, 1)], "row_id bigint, label int")
    ovr = {r["epoch"]: r["accuracy"] for r in linear.score_epochs_ovr(x, y, w).collect()}
    assert ovr == {2: 1.0, 6: pytest.approx(2 / 3)}
    single = w.where("class = 1")
    y = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "row_id bigint, label int")
    assert {r["epoch"]: r["accuracy"] for r in linear.score_epochs(x, y, single).collect()} == {2: pytest.approx(2 / 3), 6: pytest.approx(1 / 3)}


def test_stop_rule(spark):
    losses = lambda *values: spark.createDataFrame(list(enumerate(map(float, values), 1)), "epoch int, loss double")
    rule = lambda *values, **kw: tuple(linear.stop_rule(losses(*values), kw.pop("max_iter", 5), 0.1, **kw).first())
    assert rule(3, 2, 1.95, 1) == (3, "converged")
    assert rule(3, 2, 1.95, 1, 0, 0, on_converge=False) == (5, "max_iter")
    assert rule(3, math.nan, 1, max_iter=3) == (3, "NaN")
    assert rule(3, 2, 1e6, max_iter=2) == (2, "max_iter")
    assert rule(3, 2, max_iter=9) == (2, "ok")
    assert rule(3, math.inf, 1, max_iter=9) == (3, "NaN")
    assert rule(3, 1e6, 1, max_iter=3) == (3, "NaN")
    assert rule(3, 1e6, 1, max_iter=3, on_overflow=True) == (2, "NaN")
    assert linear.stop_rule(losses(), 3).count() == 0


def test_contracts_of_the_two_training_forms(spark):
    x, y = data()
    cells, labels = frames(spark, x, y)
    for packed in (True, False):
        with pytest.raises(ValueError):
            linear.minibatch_lr(cells, labels, linear.MinibatchConfig(batch_size=9, width=3), packed=packed)
        still = linear.minibatch_lr(cells, labels, linear.MinibatchConfig(batch_size=9, width=4, alpha=0.0, epochs=1), packed=packed)
        assert still.weights.count() == 0
    with pytest.raises(ValueError):
        linear.minibatch_lr(cells, labels, linear.MinibatchConfig(batch_size=9, width=10**6))


def test_vectors_have_31_bits(spark, cells, rows_of):
    with pytest.raises(ValueError):
        linear.to_vectors(cells({0: {0: 1.0}}).withColumnRenamed("f", "col"), rows_of([0]), 2**31)


def test_scores_use_the_curve_of_training(spark, cells):
    x = cells({0: {0: 1.0}, 1: {0: -6.0}, 2: {0: 0.2}})
    y = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "row_id bigint, label int")
    w = spark.createDataFrame([(1, 1, 0, 1.0)], "class int, epoch int, f bigint, w double")
    share = lambda kind: linear.score_epochs(x, y, w, sigmoid=kind).first()["accuracy"]
    assert share(None) == share("linear") == pytest.approx(2 / 3)
    # the cubic curve rises again far from zero, and the segment gives 0 beyond one half
    assert share("cube") == pytest.approx(sum(0.5 + 0.197 * z - 0.004 * z**3 >= 0.5 for z in (1, -6, 0.2)) / 3)
    assert share("segment") == pytest.approx(sum((z if -0.5 < z < 0.5 else 0) >= 0.5 for z in (1, -6, 0.2)) / 3)


# --- shares --------------------------------------------------------------------


@pytest.mark.parametrize("secret", [None, "key"])
def test_shares_hide_and_recombine(cells, secret):
    x = cells({0: {0: 1.5, 1: -2.25}, 1: {0: 0.0, 1: 7.0}})
    a, b = shares.share_split(x, secret=secret)
    assert as_dict(shares.reconstruct(a, b)) == as_dict(x)
    for part in (a, b):
        values = list(as_dict(part, "share").values())
        assert len(set(values)) == 4 and all(0 <= v < shares.RING for v in values)


def test_masks_are_uniform_and_do_not_follow_the_value(spark):
    x = spark.range(20_000).selectExpr("id as row_id", "0L as f", "1.0D as v")
    for part in shares.share_split(x):
        mean, spread = part.selectExpr(f"avg(share / {shares.RING}D)", f"stddev(share / {shares.RING}D)").first()
        assert abs(mean - 0.5) < 0.02 and abs(spread - 12**-0.5) < 0.02


def test_own_exponent_follows_the_value(spark):
    values = [0.0, 1.0, -1.0, 0.01, 3e-9, 1e-30, 123456.789, 2.0**40, 2.0**-7, -0.07]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    got = frame.select("x", shares.own_exponent(frame.x).alias("e")).collect()
    assert {r["x"]: r["e"] for r in got} == {v: math.floor((53 - math.frexp(v)[1]) / 4) for v in values}
    coded = frame.select("x", shares.fixed_encode(frame.x).alias("c"))
    back = coded.select("x", shares.fixed_decode(coded.c.encoding, coded.c.exponent).alias("y")).collect()
    for r in back:
        e = math.floor((53 - math.frexp(r["x"])[1]) / 4)
        assert r["y"] == round(r["x"] * 16.0**e) / 16.0**e


def test_values_beyond_the_ring_are_refused(spark):
    frame = spark.createDataFrame([(1e15,)], "x double")
    with pytest.raises(PySparkException):
        frame.select(shares.fixed_encode(frame.x, 4)).collect()


def test_triples_multiply(spark, cells, rows_of):
    values = {r: {f: float((r * 3 + f) % 5 - 2) for f in range(6)} for r in range(8)}
    x = cells(values)
    features = spark.range(6).withColumnRenamed("id", "f")
    triples = shares.beaver_triples(x, features, t=2)
    total = lambda df, *ids: {tuple(r[i] for i in ids): r["a"] + r["b"] for r in df.collect()}
    u, v, z = total(triples.u, "row_id", "f"), total(triples.v, "f", "t"), total(triples.z, "row_id", "t")
    for r in range(8):
        for t in range(2):
            assert z[r, t] == pytest.approx(sum(u[r, f] * v[f, t] for f in range(6)))
    shared = shares.real_split(x, "v", ["row_id", "f"], 1, "X0")
    w = shares.real_split(features.selectExpr("f", "f - 2.5D as w"), "w", ["f"], 1, "W0")
    product = total(shares.beaver_matvec(shared, w, triples), "row_id")
    assert product == {(r,): pytest.approx(sum(values[r][f] * (f - 2.5) for f in range(6)), abs=1e-9) for r in range(8)}
    rows = rows_of(range(8))
    d = shares.real_split(rows.selectExpr("row_id", "row_id / 4.0D as d"), "d", ["row_id"], 1, "D0")
    slope = total(shares.beaver_matvec_t(shared, d, shares.transposed_triples(triples, rows)), "f")
    assert slope == {(f,): pytest.approx(sum(values[r][f] * r / 4.0 for r in range(8)), abs=1e-9) for f in range(6)}


# --- encrypted sums --------------------------------------------------------------


def test_encrypted_sums_with_negatives_and_mixed_exponents(spark):
    data = [(i, "ab"[i % 2], float(i) / 8 - 3.0, float(i % 5 - 2)) for i in range(60)]
    frame = spark.createDataFrame(data, "id int, k string, x double, w double").repartition(4)
    key = TEST_KEY.public
    fine = paillier.encrypt_column(frame.where("id < 30"), "x", ["id"], key, b"one", exponent=6)
    coarse = paillier.encrypt_column(frame.where("id >= 30"), "x", ["id"], key, b"two", exponent=2)
    both = fine.unionByName(coarse)
    got = {r["k"]: r["v"] for r in paillier.decrypt_column(paillier.paillier_sum(both, ["k"], key), TEST_KEY).collect()}
    assert got == {k: pytest.approx(sum(x for _, g, x, _ in data if g == k)) for k in "ab"}
    scaled = paillier.paillier_weighted_sum(both, "w", ["k"], key, exponent=1)
    got = {r["k"]: r["v"] for r in paillier.decrypt_column(scaled, TEST_KEY).collect()}
    assert got == {k: pytest.approx(sum(x * w for _, g, x, w in data if g == k)) for k in "ab"}


def test_equal_values_get_different_ciphertexts(spark):
    frame = spark.range(50).selectExpr("id", "1.0D as x")
    sealed = paillier.encrypt_column(frame, "x", ["id"], TEST_KEY.public, b"s")
    assert sealed.select("c").distinct().count() == 50
    assert {r["v"] for r in paillier.decrypt_column(sealed, TEST_KEY).collect()} == {1.0}


def test_blinding_factor_is_an_nth_residue():
    blinder = paillier.Blinder(TEST_KEY.public)
    square, base = TEST_KEY.public.square, blinder.windows[0][1]
    exponent = 0x1234567890ABCDEF
    assert blinder.power(exponent.to_bytes(8, "little")) == pow(base, exponent, square)
    assert pow(base, (TEST_KEY.p - 1) * (TEST_KEY.q - 1), square) == 1
