import bz2

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from sketchframe.plans.sketching import SketchConfig, Split, sketch_central, sketch_vertical, sketch_width
from sketchframe.sources import samples, svmlight


def labels(data):
    return [r["label"] for r in data.y.orderBy("row_id").collect()]


def test_index_base_is_found_or_given(spark, tmp_path):
    one, zero = tmp_path / "one.txt", tmp_path / "zero.txt"
    one.write_text("1 1:0.5 3:2\n-1 2:1.25\n")
    zero.write_text("1 0:0.5 2:2\n-1 1:1.25\n")
    wanted = {(0, 0): 0.5, (0, 2): 2.0, (1, 1): 1.25}
    for path in (one, zero):
        data = svmlight.read_svmlight(spark, str(path))
        assert (as_dict(data.x), data.n, labels(data)) == (wanted, 3, [1, -1])
    shifted = svmlight.read_svmlight(spark, str(one), n=9, zero_based=True)
    assert as_dict(shifted.x) == {(r, f + 1): v for (r, f), v in wanted.items()}
    assert shifted.n == 9


def test_compressed_text(spark, tmp_path):
    path = tmp_path / "data.bz2"
    path.write_bytes(bz2.compress(b"2 1:1\n3 2:4\n"))
    data = svmlight.read_svmlight(spark, str(path))
    assert (as_dict(data.x), labels(data)) == ({(0, 0): 1.0, (1, 1): 4.0}, [2, 3])


def test_odd_lines(spark, tmp_path):
    path = tmp_path / "odd.txt"
    path.write_text("# header\n1 qid:7 2:1.5  4:0\n\n-1\n+1 1:0.1 # note 9:9\n")
    data = svmlight.read_svmlight(spark, str(path))
    assert labels(data) == [1, -1, 1]
    assert as_dict(data.x) == {(0, 1): 1.5, (2, 0): pytest.approx(0.1, rel=1e-7)}
    assert data.rows.count() == 3


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"{i} 1:1\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        data = svmlight.read_svmlight(spark, str(path), n=1, zero_based=False)
        assert data.y.rdd.getNumPartitions() > 3
        assert data.y.where("row_id <> label").count() == 0 and data.y.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.fixture
def drawn(spark):
    return spark.createDataFrame([(0, 0, 3), (0, 1, 12), (7, 0, 0), (7, 1, 0)], "row_id bigint, j bigint, s bigint")


def test_sample_files_round_trip(spark, tmp_path, drawn):
    path = str(tmp_path / "s")
    samples.write_samples(drawn, path)
    assert sorted(r[0] for r in spark.read.text(path).collect()) == ["0,3,12", "7,0,0"]
    assert as_dict(samples.read_samples(spark, path), "s", "j") == as_dict(drawn, "s", "j")


def test_foreign_sample_files_take_line_order(spark, tmp_path):
    path = tmp_path / "samples.csv"
    path.write_text("5,6\n0,0\n7,8\n")
    got = as_dict(samples.read_samples(spark, str(path), has_row_id=False), "s", "j")
    assert got == {(0, 0): 5, (0, 1): 6, (1, 0): 0, (1, 1): 0, (2, 0): 7, (2, 1): 8}


def test_sketch_files(spark, tmp_path, rows_of):
    z = spark.createDataFrame([(0, 1, 1), (2, 0, 1), (2, 3, 1)], "row_id bigint, col bigint, v int")
    samples.write_sketch(z, str(tmp_path / "z"))
    assert as_dict(samples.read_sketch(spark, str(tmp_path / "z")), "v", "col") == as_dict(z, "v", "col")
    samples.export_dense_csv(z, rows_of(range(3)), 4, str(tmp_path / "csv"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "csv")).collect()) == ["0,0,0,0", "0,1,0,0", "1,0,0,1"]


def test_layout_prunes(spark, tmp_path, drawn):
    root = str(tmp_path / "runs")
    samples.write_run(drawn, root, "d", 0.3, "SM", 2, 1)
    samples.write_run(drawn.where("row_id = 0"), root, "d", 0.3, "RBF", 2, 1, gamma=0.0123456)
    assert samples.run_path("", "d", 0.3, "RBF", 2, 1, 0.0123456).endswith("ratio=0.3/method=RBF/k=2/seed=1/gamma=0.0123456")
    one = samples.read_run(spark, root, method="RBF")
    assert one.count() == 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(method" in plan
    with pytest.raises(ValueError):
        samples.read_run(spark, root, colour="red")


def test_runs_that_differ_in_a_late_digit_do_not_meet():
    paths = {samples.run_path("", "d", p, "RBF", 2, 1, g) for p in (0.3, 0.35) for g in (0.00123, 0.00124, 8.4731e-09, 8.4735e-05)}
    assert len(paths) == 8


@pytest.mark.parametrize("before, after", [(8, 3), (2, 8)])
def test_lines_survive_another_parallelism(spark, tmp_path, before, after):
    """Lines are numbered as they were read, however the session would cut the files later."""
    path = str(tmp_path / "text")
    spark.range(20_000, numPartitions=3).selectExpr("cast(id as string) as value").write.text(path)
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(names[0], before)
        spark.conf.set(names[1], 1)
        lines = svmlight.numbered_lines(spark, path)
        spark.conf.set(names[0], after)
        spark.conf.set(names[2], "16k")
        got = lines.collect()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert sorted(r.row_id for r in got) == list(range(20_000))
    assert {r.value for r in got} == {str(i) for i in range(20_000)}
    in_order = [int(r.value) for r in sorted(got, key=lambda r: r.row_id)]
    assert sum(b < a for a, b in zip(in_order, in_order[1:])) <= 2


def test_samples_without_row_ids(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.createDataFrame([("1,2",), ("3,4",)], "value string").coalesce(1).write.text(path)
    got = {(r.row_id, r.j): r.s for r in samples.read_samples(spark, path, has_row_id=False).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}


def test_an_index_beyond_the_width_is_an_error(spark, tmp_path):
    path = str(tmp_path / "beyond")
    spark.createDataFrame([("1 1:1 5:2",)], "value string").write.text(path)
    with pytest.raises(ValueError):
        svmlight.read_svmlight(spark, path, n=4, zero_based=False)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from sketchframe.session import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


# --- plans ---------------------------------------------------------------------


@pytest.mark.parametrize("method, extra", [("SM", {"c": 8}), ("MM", {"b": 2}), ("SM", {}), ("RBF", {}), ("Poly", {})])
@pytest.mark.parametrize("portion", [0.0, 0.4])
def test_equal_rows_of_train_and_test_get_equal_sketches(spark, cells, rows_of, method, extra, portion):
    train = Split(cells({0: {0: 1.0, 3: 2.0, 9: 1.0}, 1: {5: 1.0}, 2: {}}), rows_of(range(3)))
    test = Split(cells({10: {0: 1.0, 3: 2.0, 9: 1.0}}), rows_of([10]))
    cfg = SketchConfig(method, 10, 12, portion=portion, **extra)
    run = sketch_vertical if portion else sketch_central
    a, b = (as_dict(z, "v", "col") for z in run(train, test, cfg))
    assert {c: v for (r, c), v in a.items() if r == 0} == {c: pytest.approx(v) for (_, c), v in b.items()}
    assert b and all(0 <= c < sketch_width(cfg) for _, c in a)


def test_a_party_without_samples_is_refused(cells, rows_of):
    split = Split(cells({0: {0: 1.0}}), rows_of([0]))
    with pytest.raises(ValueError):
        sketch_vertical(split, split, SketchConfig("SM", 4, 2, portion=0.3))


def test_words_are_numbered_before_they_are_exchanged(spark, tmp_path):
    """One exchange of (document, number), none of words; repeated ids add up, empty and null texts have no terms."""
    from sketchframe.sources import views

    data = [(1, "a b A"), (1, "b"), (2, "\u00c4 \u00e4-x"), (3, ""), (4, None), (None, "z z")]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    terms = views.doc_terms(spark, str(tmp_path))
    plan = terms._jdf.queryExecution().sparkPlan().toString()
    exchanged = terms._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate(") <= 2 and exchanged.count("Exchange hashpartitioning") == 1
    assert "term" not in exchanged.split("Exchange hashpartitioning")[1].split("\n")[0]
    got = sorted((r.row_id is None, r.row_id or 0, r.v) for r in terms.collect())
    assert got == [(False, 1, 2.0), (False, 1, 2.0), (False, 2, 1.0), (False, 2, 2.0), (True, 0, 2.0)]


def test_terms_are_counted_within_rows_and_meet_in_parts_that_follow_the_text(spark, tmp_path, monkeypatch):
    """No task groups what it reads before the exchange, and a task gets so many characters, whatever the session's partitions."""
    from sketchframe.sources import views

    data = [(i % 40, "b a b " * (i % 7) + "c") for i in range(200)]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(views, "CHARS_PER_TASK", 100)
    terms = views.doc_terms(spark, str(tmp_path))
    above, below = terms._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
    assert "Aggregate" in above and "Aggregate" not in below
    assert terms.rdd.getNumPartitions() == -(-sum(len(t) for _, t in data) // 100)
    want = {}
    for row, text in data:
        for word in text.split():
            want[row, word] = want.get((row, word), 0) + 1
    assert sorted(r.v for r in terms.collect()) == sorted(want.values()) and terms.groupBy("row_id", "f").count().count() == len(want)


def test_lines_meet_their_orders_in_parts_that_follow_their_number(spark, tmp_path, monkeypatch):
    """Whatever the session's partitions; repeated orders and lines count as often, lines without an order or a key not at all."""
    from sketchframe.sources import views

    lines = [(i % 50, i % 9, 2.0) for i in range(300)] + [(None, 1, 5.0), (99, 1, 7.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(i, i % 4) for i in range(50)] + [(7, 3), (None, 2)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(views, "LINES_PER_TASK", 20)
    x = views.cust_part(spark, str(tmp_path))
    assert "hashpartitioning(l_orderkey" in (plan := x._jdf.queryExecution().executedPlan().toString())
    assert "16), REPARTITION_BY_NUM" in plan
    want = {}
    for order, part, n in lines:
        for o, customer in orders:
            if o is not None and o == order:
                want[customer, part] = want.get((customer, part), 0.0) + n
    assert {(r.row_id, r.f): r.v for r in x.collect()} == want
