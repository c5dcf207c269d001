import numpy as np
import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from sketchframe.operators import scale


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """Columns with negative, zero and positive quartiles, ties, one value only, and one column with most of the cells."""
    draws = np.random.default_rng(8)
    m = 3001
    x = np.zeros((m, 8))
    x[:, 0] = np.round(draws.normal(size=m) ** 3, 3)
    x[:, 1] = np.where(draws.random(m) < 0.1, draws.normal(size=m), 0)
    x[:, 2] = np.where(draws.random(m) < 0.6, -draws.random(m), 0)
    x[:, 3] = np.where(draws.random(m) < 0.5, 1.5, 0)
    x[:, 4] = draws.integers(-2, 3, m)
    x[:, 5] = 7.0
    x[5, 6] = -3.0
    cells = [(int(r), int(f), float(x[r, f])) for r, f in zip(*x.nonzero())]
    return x, spark.createDataFrame(cells, "row_id bigint, f bigint, v double"), spark.range(m).withColumnRenamed("id", "row_id")


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quartiles_against_sorting(skewed, accuracy):
    x, df, rows = skewed
    fitted = {r.f: (r["shift"], r.spread) for r in scale.fit_robust(df, rows, len(x), 8, accuracy).collect()}
    q = np.percentile(x, [25, 50, 75], axis=0)
    assert set(fitted) == set(range(7))
    for f in fitted:
        assert fitted[f] == pytest.approx((q[1, f], q[2, f] - q[0, f])), f


@pytest.mark.parametrize("kind", ["robust", "minmax", "standard"])
@pytest.mark.parametrize("chunk", [10_000, 1])
def test_scaled_tables_against_numpy(skewed, kind, chunk, monkeypatch):
    monkeypatch.setattr(scale, "CHUNK", chunk)
    x, df, rows = skewed
    got = as_dict(getattr(scale, f"scale_{kind}")(df, rows, len(x), 8))
    if kind == "robust":
        q = np.percentile(x, [25, 50, 75], axis=0)
        shift, spread = q[1], q[2] - q[0]
    elif kind == "minmax":
        shift, spread = x.min(axis=0), x.max(axis=0) - x.min(axis=0)
    else:
        shift, spread = x.mean(axis=0), x.std(axis=0)
    want = (x - shift) / np.where(np.abs(spread) < 1e-12, 1.0, spread)
    dense = np.zeros_like(x)
    for (r, f), v in got.items():
        dense[r, f] = v
    assert np.allclose(dense, want, atol=1e-9)


@pytest.fixture(scope="module")
def wide(spark):
    """100,000 rows of 20 cells over a million columns: 10 ** 11 places, two million cells."""
    cells = spark.range(100_000).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("j"))
    f = F.pmod(F.xxhash64("row_id", "j"), F.lit(50_000)) + F.col("j") * 50_000
    return cells.select("row_id", f.alias("f"), (1.0 + F.pmod(F.xxhash64("j", "row_id"), F.lit(7))).alias("v")), spark.range(100_000).withColumnRenamed("id", "row_id")


@pytest.mark.parametrize("kind", ["robust", "minmax"])
def test_a_wide_table_is_never_unfolded(wide, kind):
    """Zeros are the least value and the quartiles of every column, so none of them has a shift."""
    df, rows = wide
    n = df.count()
    scaled = getattr(scale, f"scale_{kind}")(df, rows, 100_000, 10**6)
    assert "generate explode(zeros" not in plan(scaled).lower()
    row = scaled.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    assert (row.n, row.high) == (n, 7.0 if kind == "robust" else 1.0) and row.low > 0


def test_only_shifted_columns_unfold(spark, wide):
    """One column of a million has a shift: it alone gets a cell in every row."""
    df, rows = wide
    extra = rows.where("row_id % 4 <> 0").select("row_id", F.lit(10**6).cast("bigint").alias("f"), F.lit(2.0).alias("v"))
    both = df.unionByName(extra)
    scaled = scale.scale_robust(both, rows, 100_000, 10**6 + 1)
    counts = scaled.groupBy((F.col("f") == 10**6).alias("own")).agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()
    by = {r.own: r for r in counts}
    assert by[False].n == df.count()
    # quartiles 1.5 (between 0 and 2), 2 and 2: zeros become -2 / 0.5 where the spread says so
    column = np.where(np.arange(100_000) % 4 != 0, 2.0, 0.0)
    q = np.percentile(column, [25, 50, 75])
    want = (column - q[1]) / ((q[2] - q[0]) or 1.0)
    assert by[True].n == np.count_nonzero(want) and by[True].s == pytest.approx(want.sum())


def test_empty_and_without_rows(spark, rows_of):
    none = spark.createDataFrame([], "row_id bigint, f bigint, v double")
    for kind in ("robust", "minmax", "standard"):
        assert getattr(scale, f"scale_{kind}")(none, rows_of([1, 2]), 2, 3).count() == 0
