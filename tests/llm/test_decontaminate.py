import random

import pytest

from sketchframe.llm import decontaminate
from sketchframe.session import write_out

rng = random.Random(9)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(900)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PLAIN = [prose(40).capitalize() + "." for _ in range(6)]
SUM = "A train leaves the old town with 120 people and after 35 km in the hills Maria and 12 others step out so that 107 stay"
SHORT = "gadget bakes hefty"
ITEMS = [(k, t) for k, t in enumerate(PLAIN)] + [(10, SUM), (11, SHORT), (12, None), (13, ""), (14, "1 2 3 4 5 6 7 8 9 10 11 12"), (10, SUM)]

OTHER = SUM.replace("120", "90").replace("35 km", "7 miles").replace("Maria", "Peter").replace("12 others", "5 others").replace("107", "85")
MIXED_UP = "in 5 of 5 it says that he has 5 red and 5 blue"
DOCS = [
    (0, prose(200)),
    (1, prose(30) + ". " + PLAIN[0] + " " + prose(30)),
    (2, prose(30) + "\n" + PLAIN[1].upper().replace(" ", " - ") + "\n" + PLAIN[2]),
    (3, "x. " + OTHER + ". " + prose(20)),
    (4, SUM),
    (5, "say " + SHORT + " now"),
    (6, None),
    (7, ""),
    (8, " ".join(PLAIN[3].split()[:10])),
    (9, " ".join(PLAIN[4].split()[:20])),
    (10, "20 1 2 3 4 5 6 7 8 9 10 11 12"),
    (11, (PLAIN[5] + " ") * 300),
    (1, prose(12)),
    (None, PLAIN[0]),
    (4, SUM),
]
WANT = {(1, 0), (2, 1), (2, 2), (3, 10), (4, 10), (5, 11), (9, 4), (11, 5), (None, 0)}


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in ITEMS], "item_id bigint, text string, key string, at int")


@pytest.mark.parametrize("limit", [500_000, 0])
def test_leaks(documents, items, limit):
    """Both where the windows are sent to the tasks and where both sides are exchanged."""
    got = decontaminate.leaks(documents(DOCS), items, limit=limit).collect()
    assert {(r.doc_id, r.item_id) for r in got} == WANT
    by = {(r.doc_id, r.item_id): r for r in got}
    assert by[(4, 10)].changed == 0 and by[(3, 10)].changed == 6 and by[(3, 10)].slots == by[(4, 10)].slots == 6
    assert by[(4, 10)].share == 1.0 and by[(11, 5)].share == 1.0 and by[(11, 5)].matched == by[(11, 5)].windows
    assert 0.25 <= by[(9, 4)].share < 0.6


def test_slots_must_be_consistent(spark, documents):
    item = spark.createDataFrame([(1, "the box has 5 red and 5 blue balls and all 5 red balls weigh more")], "item_id bigint, text string")
    docs = documents([(1, "the box has 8 red and 8 blue balls and all 8 red balls weigh more"), (2, "the box has 8 red and 3 blue balls and all 9 red balls weigh more")])
    assert [r.doc_id for r in decontaminate.leaks(docs, item).collect()] == [1]


def test_words_match_one_for_one(spark):
    rows = [("İx 5kg Anna ½a é́ b7c",), ("A. Bob, Carl; don't 3.5 km-h x  y",), ("",), ("...",)]
    from pyspark.sql import functions as F

    text = F.col("t")
    for r in spark.createDataFrame(rows, "t string").select(decontaminate.raw_words(text).alias("r"), decontaminate.template_words(text).alias("p")).collect():
        assert len(r.r) == len(r.p), r


def test_clean(documents, items):
    docs = documents(DOCS)
    got = decontaminate.clean(docs, items)
    assert got.columns == docs.columns
    gone = {(i, t) for i, t in DOCS if (i, t) in {(1, DOCS[1][1]), (2, DOCS[2][1]), (3, DOCS[3][1]), (4, SUM), (5, DOCS[5][1]), (9, DOCS[9][1]), (11, DOCS[11][1]), (None, PLAIN[0])}}
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([d for d in DOCS if d not in gone], key=str)


def test_empty_tables(spark, documents, items):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.leaks(documents(DOCS), none).count() == 0
    assert decontaminate.leaks(documents([]), items).count() == 0
    assert decontaminate.clean(documents(DOCS), none).count() == len(DOCS)


def test_every_planted_item_is_found(spark):
    """All items that stand verbatim in a document, over a whole table."""
    root = "/root/testdata/sf0.01"
    docs = write_out(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text"), "docs")
    bench = spark.read.parquet(f"{root}/benchmark.parquet")
    want = {(r.doc_id, i.item_id) for i in bench.collect() for r in docs.where(docs.text.contains(i.text)).collect()}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == want


def only_leak(spark, documents, item, text):
    found = decontaminate.leaks(documents([(1, text)]), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert len(found) <= 1
    return found[0] if found else None


def test_one_conflict_costs_the_windows_around_it(spark, documents):
    words = [rng.choice(WORDS) for _ in range(217)]
    words[50] = words[150] = "2"
    copy = list(words)
    copy[150] = "3"
    found = only_leak(spark, documents, " ".join(words), " ".join(copy))
    assert (found.windows, found.matched, found.changed) == (210, 210, 1)
    # both in one window: only the windows that hold both conflict
    words[150], words[54] = "x", "2"
    copy = list(words)
    copy[54] = "3"
    found = only_leak(spark, documents, " ".join(words), " ".join(copy))
    assert (found.windows, found.matched) == (210, 206)


def test_equal_values_may_be_different_variables(spark, documents):
    item = "the shop on the corner sells 2 pens to every child that comes in and each of them costs 2 dollars at noon"
    found = only_leak(spark, documents, item, item.replace("2 pens", "3 pens").replace("2 dollars", "5 dollars"))
    assert found.matched == found.windows


def test_items_of_numbers_are_found_verbatim(spark, documents):
    item = "What is 12 + 7 - 3 + 45 - 6 + 9 + 81 - 4 + 2 + 66?"
    found = only_leak(spark, documents, item, prose(20) + ". " + item + " " + prose(5))
    assert found.windows == found.matched == 5 and found.changed == 0
    # other numbers alone tell nothing
    assert only_leak(spark, documents, item, "What is 13 + 8 - 2 + 44 - 7 + 1 + 80 - 5 + 3 + 67?") is None


def test_items_without_an_id(spark, documents):
    items = spark.createDataFrame([(None, PLAIN[0]), (None, PLAIN[1]), (3, PLAIN[2])], "item_id bigint, text string")
    found = decontaminate.leaks(documents([(1, PLAIN[0]), (2, PLAIN[2]), (3, PLAIN[1])]), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, None), (2, 3), (3, None)}


def test_names_anywhere(spark, documents):
    item = "Tom has 5 apples. Ann has 7. Tom gives Ann 2 apples. How many does Tom have?"
    again = "Sam has 6 apples. Eve has 9. Sam gives Eve 3 apples. How many does Sam have?"
    for before in ("", "x. ", "say: \"", "\n", "now "):
        found = only_leak(spark, documents, item, before + again)
        assert found is not None and found.share >= 0.25 and found.changed >= 5, before
        assert only_leak(spark, documents, item, before + item).share == 1.0
    assert only_leak(spark, documents, "Alice has 3 apples", "Now Alice has 3 apples").share == 1.0
    assert only_leak(spark, documents, "Now Alice has 3 red apples", "now Peter has 4 red apples") is None
    assert only_leak(spark, documents, item, item.upper()).share == 1.0
