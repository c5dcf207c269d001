"""Committed runs, and many layouts from one read of stored samples."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sketchframe.plans.sketching import SketchConfig, Split, squeeze_grid, squeeze_samples, store_party_samples
from sketchframe.sources import samples


def numbers(spark, n):
    return spark.range(n).select(F.col("id").alias("row_id"), F.lit(0).cast("bigint").alias("j"), F.col("id").alias("s"))


def test_a_writer_that_is_lost_leaves_the_old_run(spark, tmp_path):
    """Lost before its rows are complete, and between the rows and the commit."""
    root = str(tmp_path)
    samples.write_run(numbers(spark, 3), root, "d", 0.5, "SM", 1, 1)
    broken = numbers(spark, 9).withColumn("s", F.when(F.col("s") > 7, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("s")))
    with pytest.raises(Exception, match="lost"):
        samples.write_run(broken, root, "d", 0.5, "SM", 1, 1)
    numbers(spark, 9).write.parquet(samples.run_path(root, "d", 0.5, "SM", 1, 1) + "/version=dead")
    assert samples.read_run(spark, root, dataset="d").count() == 3


def test_a_new_version_takes_the_place_and_readers_keep_theirs(spark, tmp_path):
    root = str(tmp_path)
    for n in (3, 4):
        samples.write_run(numbers(spark, n), root, "d", 0.5, "SM", 1, 1)
        if n == 3:
            before = samples.read_run(spark, root)
    assert (before.count(), samples.read_run(spark, root).count()) == (3, 4)
    assert [r["number"] for r in samples.committed_runs(spark, root).collect()] == [2]


def test_conditions_choose_runs(spark, tmp_path):
    root = str(tmp_path)
    for k, gamma in ((1, None), (2, 1e-9), (3, 0.25)):
        samples.write_run(numbers(spark, k), root, "07", 0.5, "RBF", k, 1, gamma)
    assert samples.read_run(spark, root, gamma=1e-9).count() == 2
    assert samples.read_run(spark, root, gamma=None).count() == 1
    assert {r["gamma"] for r in samples.read_run(spark, root, ratio=0.5).select("gamma").distinct().collect()} == {"none", "1e-09", "0.25"}
    none = samples.read_run(spark, root, k=9)
    assert none.count() == 0 and none.columns == samples.read_run(spark, root).columns


def test_no_run_at_all(spark, tmp_path):
    with pytest.raises(ValueError, match="no committed run"):
        samples.read_run(spark, str(tmp_path))


@pytest.fixture(scope="module")
def stored(spark, cells, rows_of, tmp_path_factory):
    where = tmp_path_factory.mktemp("grid")
    cfg = SketchConfig("SM", 30, 12, portion=0.4)
    rows = {r: {(r * 7 + 3 * i) % 30: float(i + 1) for i in range(r % 6)} for r in range(25)}
    store_party_samples(Split(cells(rows), rows_of(range(25))), cfg, f"{where}/a", f"{where}/b")
    return cfg, f"{where}/a", f"{where}/b", (cells(rows), rows_of(range(25)))


SIZES = {"plain": {}, "b1": {"b": 1}, "b3": {"b": 3}, "c4": {"c": 4}, "c8": {"c": 8}, "c64": {"c": 64}}


@pytest.mark.parametrize("align", ["portion", "party"])
def test_every_layout_of_a_grid_equals_its_own_run(spark, stored, tmp_path, align):
    cfg, a, b, _ = stored
    layouts = {name: replace(cfg, **size) for name, size in SIZES.items()}
    grid = squeeze_grid(spark, a, b, layouts, str(tmp_path / "grid"), align)
    for name, one in layouts.items():
        left, right = squeeze_samples(spark, a, b, one, align=align)
        for party, own in (("a", left), ("b", right)):
            got = grid.where(f"layout = '{name}' and party = '{party}'").select("row_id", "col", "v")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, own.select("row_id", "col", "v").collect())), (name, party)


def test_fewer_draws_are_the_first_ones(spark, stored, tmp_path):
    cfg, a, b, split = stored
    short = replace(cfg, k=5, c=8)
    store_party_samples(Split(*split), short, f"{tmp_path}/a", f"{tmp_path}/b")
    left, right = squeeze_samples(spark, f"{tmp_path}/a", f"{tmp_path}/b", short)
    got = squeeze_grid(spark, a, b, {"short": short})
    for party, own in (("a", left), ("b", right)):
        assert sorted(map(tuple, got.where(f"party = '{party}'").select("row_id", "col").collect())) == sorted(map(tuple, own.select("row_id", "col").collect()))


def test_a_grid_reads_the_samples_once(spark, stored):
    cfg, a, b, _ = stored
    plan = squeeze_grid(spark, a, b, {name: replace(cfg, **size) for name, size in SIZES.items()})._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan text", plan)) == 2 and "Exchange" not in plan  # one for each party


def test_grids_that_make_no_sense(spark, stored):
    cfg, a, b, _ = stored
    for bad in ({}, {"x": replace(cfg, b=1, c=2)}, {"x": replace(cfg, portion=0.0)}, {"x": replace(cfg, method="RBF")}):
        with pytest.raises(ValueError):
            squeeze_grid(spark, a, b, bad)
