import pytest
from conftest import as_dict
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sketchframe.operators import joins, reshape, scale, stats


def test_triples_add_up_and_zeros_vanish(spark):
    data = [(1, 2, 3.0), (1, 2, 4.0), (2, 5, 1.0), (2, 5, -1.0)]
    x = reshape.weighted_set(spark.createDataFrame(data, "r int, c int, w double"), "r", "c", "w")
    assert as_dict(x) == {(1, 2): 7.0}


def test_signs_get_their_own_columns(cells):
    train, test = cells({0: {0: 1.5, 2: -2.0}, 2: {1: 3.0}}), cells({5: {2: 1.0}})
    a, b, width = reshape.separate_signs(train, test, 3)
    assert as_dict(a) == {(0, 0): 1.5, (0, 5): 2.0, (2, 2): 3.0}
    assert (as_dict(b), width) == ({(5, 4): 1.0}, 6)


def test_signs_untouched_without_negatives(cells):
    train = cells({0: {0: 1.5}})
    a, _, width = reshape.separate_signs(train, cells({1: {1: 2.0}}), 3)
    assert (a, width) == (train, 3)
    assert reshape.separate_signs(train, cells({1: {1: -2.0}}), 3)[2] == 6


@pytest.mark.parametrize("picked", [0, 1, 250, 999, 1000])
def test_row_sample_is_exact_and_repeatable(spark, picked):
    rows = spark.range(1000).withColumnRenamed("id", "row_id")
    x = rows.select("row_id", F.lit(0).cast("bigint").alias("f"), F.lit(1.0).alias("v"))
    first = {r["row_id"] for r in reshape.sample_rows(x, rows, picked, m=1000).collect()}
    again = {r["row_id"] for r in reshape.sample_rows(x, rows.repartition(3), picked).collect()}
    assert len(first) == picked and first == again


def test_row_sample_checks_sizes(spark):
    rows = spark.range(10).withColumnRenamed("id", "row_id")
    with pytest.raises(ValueError):
        reshape.sample_rows(rows, rows, 11)
    with pytest.raises(ValueError):
        reshape.sample_rows(rows, rows, 5, m=9)


def test_width(cells):
    x = cells({0: {0: 1.0, 4: 2.0}})
    assert as_dict(reshape.fit_width(x, 10)) == as_dict(x)
    assert as_dict(reshape.fit_width(x, 4, "truncate")) == {(0, 0): 1.0}
    with pytest.raises(PySparkException):
        reshape.fit_width(x, 4).collect()


def test_vertical_split_and_back(cells):
    x = cells({0: {0: 1.0, 2: 2.0, 3: 3.0}})
    a, b = reshape.vertical_split(x, 7, reshape.portion_from_code(46))
    assert as_dict(a) == {(0, 0): 1.0}
    assert as_dict(b) == {(0, 0): 2.0, (0, 1): 3.0}
    assert as_dict(joins.hstack(a, b, 2)) == as_dict(x)


def test_bias_transpose_dense(cells, rows_of):
    x = cells({0: {1: 2.0}, 1: {}})
    rows = rows_of([0, 1])
    assert as_dict(reshape.add_bias(x, rows)) == {(0, 0): 1.0, (1, 0): 1.0, (0, 2): 2.0}
    assert as_dict(reshape.transpose(x)) == {(1, 0): 2.0}
    dense = reshape.to_dense(x, rows, 2)
    assert as_dict(dense) == {(0, 0): 0.0, (0, 1): 2.0, (1, 0): 0.0, (1, 1): 0.0}
    assert as_dict(reshape.to_long(dense)) == as_dict(x)


def test_labels(spark):
    def y(*labels):
        return spark.createDataFrame(list(enumerate(labels)), "row_id bigint, label int")

    train, test = reshape.binarize_labels(y(-1, 1, 3), y(1, 2))
    assert [r["label"] for r in train.orderBy("row_id").collect()] == [0, 1, 0]
    assert [r["label"] for r in test.orderBy("row_id").collect()] == [1, 0]
    train, test = reshape.binarize_labels(y(0, 1, 3), y(-1, 2))
    assert [r["label"] for r in test.orderBy("row_id").collect()] == [-1, 2]
    ovr = {(r["class"], r["row_id"]): r["label"] for r in reshape.ovr_labels(y(4, 7)).collect()}
    assert ovr == {(4, 0): 1, (4, 1): 0, (7, 0): 0, (7, 1): 1}


def test_batches_with_remainder(rows_of):
    batches = reshape.batch_rows(rows_of([3, 10, 11, 40, 41, 99, 100]), 3)
    got = {r["row_id"]: r["batch"] for r in batches.collect()}
    assert got == {3: 0, 10: 0, 11: 0, 40: 1, 41: 1, 99: 1, 100: 2}
    sizes = {r["batch"]: r["size"] for r in reshape.batch_sizes(batches).collect()}
    assert sizes == {0: 3, 1: 3, 2: 1}


def test_numbering_is_contiguous_on_uneven_ids(spark):
    ids = [0, 1, 2, 10**15, 10**15 + 1, 2**62] + list(range(5000, 9000))
    df = spark.createDataFrame([(i,) for i in ids], "row_id bigint").repartition(5)
    got = reshape.row_index(df).orderBy("row_id").collect()
    assert [r["idx"] for r in got] == list(range(len(ids)))
    assert [r["row_id"] for r in got] == sorted(ids)


def test_shuffled_batches_are_a_permutation(spark):
    batches = spark.range(100).selectExpr("id as row_id", "id div 7 as batch")
    one = {r["batch"]: r["position"] for r in reshape.shuffle_batches(batches, epoch=1).collect()}
    two = {r["batch"]: r["position"] for r in reshape.shuffle_batches(batches, epoch=2).collect()}
    assert sorted(one.values()) == list(range(15)) and one != two


def test_parties_must_match(rows_of):
    with pytest.raises(ValueError):
        joins.align_parties(rows_of([1, 2]), rows_of([2, 3]))
    assert joins.align_parties(rows_of([1, 2]), rows_of([2, 3]), strict=False).count() == 1
    assert joins.align_parties(rows_of([1, 2]), rows_of([2, 1])).count() == 2
    assert {(r[0], r[1]) for r in joins.unmatched_rows(rows_of([1, 2]), rows_of([2, 3])).collect()} == {(1, "a"), (3, "b")}


# --- reports -------------------------------------------------------------------


def test_minimum_and_variance_count_implicit_zeros(cells):
    x = cells({0: {0: 2.0, 1: 4.0}, 1: {0: 6.0}})
    assert stats.matrix_min(x, 2, 2).first()[0] == 0.0
    assert stats.matrix_min(cells({0: {0: 2.0}}), 1, 1).first()[0] == 2.0
    assert stats.matrix_variance(x, 2, 2).first()[0] == pytest.approx(56 / 4 - 9)


def test_gamma_rules(cells):
    x = cells({0: {0: 2.0, 1: 4.0}, 1: {0: 6.0}})
    value = lambda **kw: stats.resolve_gamma(x, 2, 2, **kw).first()["gamma"]
    assert value(gamma=0.25) == 0.25
    assert value(mode="auto") == 0.5
    assert value(mode="auto", normalization=True) == 0.25
    assert value() == pytest.approx(0.5 / 5.0)
    base = stats.resolve_gamma(x, 2, 27648, mode="auto").first()["base"]
    assert base == 3.616898148148148e-05


def test_best_epoch_takes_the_earliest(spark):
    metrics = spark.createDataFrame([(1, 0.5, "x"), (2, 0.7, "y"), (3, 0.7, "z")], "epoch int, accuracy double, status string")
    assert tuple(stats.best_epoch(metrics).first()) == (2, 0.7, "y")
    broken = spark.createDataFrame([(1, float("nan"), "x"), (2, 0.1, "y")], "epoch int, accuracy double, status string")
    assert tuple(stats.best_epoch(broken).first()) == (2, 0.1, "y")


def test_reports(spark):
    s = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (1, 0, 5), (1, 1, -1)], "row_id bigint, j bigint, s bigint")
    assert tuple(stats.zero_report({"a": s}).first()) == ("a", 1, 3)
    assert tuple(stats.shape_report({"a": s}).first()) == ("a", 2, 2)
    y = spark.createDataFrame([(1,), (1,), (2,)], "label int")
    assert {tuple(r) for r in stats.class_summary(y, y.limit(1), 2).collect()} == {(1, 2, 1), (2, 1, 0)}
    with pytest.raises(ValueError):
        stats.class_summary(y, y, 3)
    p = spark.createDataFrame([(1, 1), (0, 1)], "prediction int, label int")
    assert stats.accuracy(p, percent=True).first()["accuracy"] == 50.0


# --- scalers -------------------------------------------------------------------

TABLE = {r: {0: float(r * r % 11), 1: 5.0, 3: -float(r % 4), 4: 7.0 if r % 3 else 0.0} for r in range(40)}


def matrix(rows, n=5):
    np = pytest.importorskip("numpy")
    return np.array([[rows[r].get(f, 0.0) for f in range(n)] for r in sorted(rows)])


def expected(kind, train, data):
    import numpy as np

    if kind == "minmax":
        shift, width = train.min(0), train.max(0) - train.min(0)
    elif kind == "standard":
        shift, width = train.mean(0), train.std(0)
    else:
        q = np.percentile(train, [25, 50, 75], axis=0)
        shift, width = q[1], q[2] - q[0]
    return (data - shift) / np.where(width == 0, 1, width)


@pytest.mark.parametrize("kind", ["minmax", "standard", "robust"])
def test_scaler_fits_on_train_and_applies_to_both(cells, rows_of, kind):
    import numpy as np

    other = {r: {0: 3.0, 2: 1.5, 3: 2.0} for r in range(3)}
    clean = lambda rows: {r: {f: v for f, v in fv.items() if v} for r, fv in rows.items()}
    train, test = cells(clean(TABLE)), cells(other)
    rows, m = rows_of(TABLE), len(TABLE)
    fit = {
        "minmax": lambda: scale.fit_minmax(train, m),
        "standard": lambda: scale.fit_standard(train, m),
        "robust": lambda: scale.fit_robust(train, rows, m, 5),
    }[kind]()
    run = getattr(scale, f"scale_{kind}")
    for frame, ids, data in ((train, rows, TABLE), (test, rows_of(other), other)):
        got = as_dict(run(frame, ids, m, 5, fit))
        dense = np.array([[got.get((r, f), 0.0) for f in range(5)] for r in sorted(data)])
        assert np.allclose(dense, expected(kind, matrix(TABLE), matrix(data)))
    assert as_dict(run(train, rows, m, 5)) == as_dict(run(train, rows, m, 5, fit))


def test_robust_brackets_are_exact_on_many_values(spark):
    import numpy as np

    m = 20_000
    values = np.random.default_rng(5).permutation(m).astype(float) ** 2
    x = spark.createDataFrame(list(zip(range(m), [0] * m, values.tolist())), "row_id bigint, f bigint, v double")
    x = x.where("v <> 0")
    fitted = scale.fit_robust(x, spark.range(m).withColumnRenamed("id", "row_id"), m, 1, accuracy=100).first()
    q = np.percentile(values, [25, 50, 75])
    assert (fitted["shift"], fitted["spread"]) == (pytest.approx(q[1]), pytest.approx(q[2] - q[0]))


def test_row_and_maxabs_scaling(cells):
    x = cells({0: {0: 3.0, 1: -4.0}, 1: {0: 6.0}})
    assert as_dict(scale.scale_normalize(x)) == {(0, 0): 0.6, (0, 1): -0.8, (1, 0): 1.0}
    assert as_dict(scale.scale_maxabs(x, 2)) == {(0, 0): 0.5, (0, 1): -1.0, (1, 0): 1.0}
