"""Stages give every column back as it was, whatever its name and type."""

import pytest
from pyspark.sql import functions as F

from sketchframe.llm import decontaminate, exact, near, toxicity

NAMES = [
    "_own", "_hash", "_maybe", "_page", "_bit", "_map", "_rows", "_kept", "_id", "_mark", "_key", "_row", "_text_key", "row", "mark", "hash", "id", "key",
    "rows", "kept", "h", "band", "print", "root", "lead", "n", "size", "pos", "item_id", "at", "word", "with.dot", "with space",
]
LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, LONG), (5, LONG), (6, LONG + " more"), (None, "c"), (None, "c"), (9, "What do seven red apples cost at the small shop by the river")]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    more = [F.concat(F.lit(f"{name} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(name) for name in NAMES]
    kinds = F.create_map(F.lit("k"), F.col("doc_id")).alias("a_map"), F.array("doc_id").alias("a_list"), F.struct("text").alias("a_struct"), F.lit(None).alias("nothing")
    return docs.select("*", *more, *kinds)


@pytest.fixture(scope="module")
def stages(spark):
    benchmark = spark.createDataFrame([(1, ROWS[-1][1])], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    return {
        "exact": (lambda d: exact.deduplicate(d, "largest"), {2, 4, 5, 6, None, 9}),
        "near": (near.deduplicate, {1, 3, 5, None, 9}),
        "clean": (lambda d: decontaminate.clean(d, benchmark), {1, 2, 3, 4, 5, 6, None}),
        "reject": (lambda d: toxicity.reject(d, toxicity.fit(d, labels, F.lit(True)), threshold=2.0), {1, 2, 3, 4, 5, 6, None, 9}),
    }


@pytest.mark.parametrize("stage", ["exact", "near", "clean", "reject"])
def test_columns_come_back(odd, stages, stage):
    run, kept = stages[stage]
    got = run(odd)
    assert got.schema.simpleString() == odd.schema.simpleString()
    seen = got.collect()
    assert {r["doc_id"] for r in seen} == kept
    for r in seen:
        who = "none" if r["doc_id"] is None else str(r["doc_id"])
        assert all(r[name] == f"{name} {who}" for name in NAMES)
        assert r["a_map"] == {"k": r["doc_id"]} and r["a_list"] == [r["doc_id"]] and r["a_struct"]["text"] == r["text"] and r["nothing"] is None


@pytest.mark.parametrize("stage", ["exact", "near", "clean", "reject"])
def test_an_empty_table_keeps_its_columns(odd, stages, stage):
    got = stages[stage][0](odd.where("false"))
    assert got.count() == 0 and got.columns == odd.columns
