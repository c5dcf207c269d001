import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sketchframe.llm import simhash
from sketchframe.llm.queries import QUERIES

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
SPACE = " \t\n\x0b\x0c\r"


def plain_print(text):
    """The definition, shingle by shingle."""
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """{print: least print of its component} by comparing all pairs."""
    prints = sorted(set(prints))
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def check(rows, got):
    prints = [plain_print(t) for _, t in rows]
    root = plain_components(prints)
    least, size = {}, {}
    for (i, _), p in zip(rows, prints):
        ids = [v for v in (least.get(root[p]), i) if v is not None]
        least[root[p]] = min(ids) if ids else None
        size[root[p]] = size.get(root[p], 0) + 1
    want = sorted((str(i), f"{p:016x}", str(least[root[p]]), size[root[p]]) for (i, _), p in zip(rows, prints))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id), r.component_size) for r in got) == want


def edited(base, n):
    """Copies of a text with one or two words changed: a large group of which most are linked only through others."""
    made = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.choice((1, 1, 2))):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        made.append(" ".join(words))
    return made


def prose(n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    texts = [" ".join(prose(rng.randrange(1, 120))) for _ in range(60)]
    texts += edited(prose(90), 150) + edited(prose(300), 40)
    texts += [texts[3]] * 20 + [None, "", " \n\t", "a", "A b", "a  B\nc", "Ä ä x y z   w", "word " * 30000, " ".join(prose(70000))]
    out = list(enumerate(texts, 100))
    return out + [(None, texts[0]), (None, "only without an id"), (100, texts[0]), (100, texts[0]), (7, texts[70])]


@pytest.mark.parametrize("direct", [64, 4, 1])
def test_components_against_all_pairs(documents, rows, direct):
    """The size from which on buckets meet at points between their members changes nothing."""
    check(rows, simhash.classes(documents(rows), direct=direct).collect())


def test_a_table_without_rows(documents):
    assert simhash.classes(documents([])).count() == 0
    check([(4, None)], simhash.classes(documents([(4, None)])).collect())


def test_every_link_shares_a_bucket(spark):
    """All places of one to four differing bits, at random: one of the 40 buckets holds both, and the chain passes there."""
    from pyspark.sql import functions as F

    pairs = []
    for _ in range(1500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(1, 5)):
            b ^= 1 << bit
        pairs.append((a, b))
    signed = [(a - (a >> 63 << 64), b - (b >> 63 << 64)) for a, b in pairs]
    table = spark.createDataFrame(signed, "a bigint, b bigint")
    left = simhash._buckets(table.select(F.col("a").alias("print"))).select(F.col("print").alias("a"), "bucket", F.col("ring").alias("x"))
    right = simhash._buckets(table.select(F.col("b").alias("print"))).select(F.col("print").alias("b"), "bucket", F.col("ring").alias("y"))
    met = left.join(table.distinct(), "a").join(right, ["b", "bucket"]).where(simhash._linked(F.col("x"), F.col("y")))
    assert {(r.a, r.b) for r in met.select("a", "b").distinct().collect()} == set(signed)


def test_points_are_all_within_two_bits(spark):
    made = simhash._points(spark.createDataFrame([(5, 1), (-1, 2)], "print bigint, root bigint")).collect()
    by = {root: {r.point & (1 << 64) - 1 for r in made if r.root == root} for root in (1, 2)}
    assert len(made) == 2 * 2081
    for root, value in ((1, 5), (2, (1 << 64) - 1)):
        assert len(by[root]) == 2081 and all((value ^ p).bit_count() <= 2 for p in by[root])


def test_hot_group_emits_no_pairs(spark):
    """Thousands of fingerprints in one bucket, in two chains that meet in the middle."""
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 1500:
        p = base
        for bit in rng.sample(range(40), rng.randrange(1, 8)):
            p ^= 1 << bit
        prints.add(p)
    nodes = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "print bigint")
    got = {r.node: r.root for r in simhash._links(nodes, 64).collect()}
    root = plain_components([p for p in prints])
    groups, mine = {}, {}
    for p in prints:
        s = p - (p >> 63 << 64)
        groups.setdefault(root[p], set()).add(s)
        mine.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_whole_table(spark):
    root = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    got = QUERIES["op13_simhash_near_dedup"](spark, root).collect()
    prints = [plain_print(t) for _, t in rows]
    component = plain_components(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        least[component[p]] = min(i, least.get(component[p], i))
    assert sorted(tuple(r) for r in got) == sorted((i, f"{p:016x}", least[component[p]]) for (i, _), p in zip(rows, prints))


def test_counts_of_bits():
    h = np.array([rng.getrandbits(64) for _ in range(700)], np.uint64)
    assert simhash._set_bits(h).tolist() == [sum(int(x) >> b & 1 for x in h) for b in range(63, -1, -1)]
