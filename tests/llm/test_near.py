import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sketchframe.llm import near
from sketchframe.llm.components import components
from sketchframe.llm.text import flat, shingles
from sketchframe.session import LEAST_PARTS, PART_ROWS, in_parts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def weights(text, size=5):
    words = WORD.findall((text or "").translate(LOW))
    found = {}
    for i in range(max(1, len(words) - size + 1) if words else 0):
        s = tuple(words[i : i + size])
        found[s] = found.get(s, 0) + 1
    return {s: 1 + np.log(n) for s, n in found.items()}


def similarity(x, y):
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
    return total


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 7))) for _ in range(900)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    rows, i = [], 0
    for _ in range(12):
        base = make(rng.randrange(30, 120))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(i + k, t) for k, t in enumerate(["", None, "!!!", "???", "!!!", "one two", "One, two!", "one two three", "z " * 400])]
    rows += [rows[3], (None, rows[5][1]), (None, "alone in the world of words and ids")]
    return rows


def brute(rows, threshold=0.8):
    sets = [weights(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        same = sets[a] == sets[b] and (sets[a] or (rows[a][1] or "") == (rows[b][1] or ""))
        if same or (sets[a] and sets[b] and similarity(sets[a], sets[b]) >= threshold):
            parent[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    out = []
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        best = min(ids) if ids else None
        out += [(rows[k][0], best, len(members), rows[k][0] == best) for k in members]
    return sorted(out, key=str)


def test_classes_against_all_pairs(documents):
    rows = corpus()
    got = near.near_classes(documents(rows)).select("doc_id", "class_id", "class_size", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_a_group_linked_only_through_edits_of_edits(documents):
    """A chain in which only neighbours are alike is one class."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    rows, text = [], list(words)
    for i in range(25):
        rows.append((i, " ".join(text)))
        at = rng.randrange(200)
        text = text[:at] + [f"x{i}"] + text[at + 1 :]
    got = near.near_classes(documents(rows)).collect()
    assert {r.class_id for r in got} == {0}
    assert sorted(map(tuple, near.near_classes(documents(rows)).select("doc_id", "class_id", "class_size", "kept").collect()), key=str) == brute(rows)


def test_a_hot_group_of_edited_copies(documents):
    """Copies of one text that share most buckets, many of them just below the threshold from each other."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(221)]  # 217 shingles: no two sets of them are at 0.8 exactly
    rows = []
    for i in range(45):
        text = list(base)
        for _ in range(rng.randrange(1, 8)):
            text[rng.randrange(221)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    want = brute(rows)
    assert len({r[1] for r in want}) > 3 and max(r[2] for r in want) > 10
    for further in (8, near.FURTHER):
        got = near.near_classes(documents(rows), further=further).select("doc_id", "class_id", "class_size", "kept").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_deduplicate(documents):
    docs = documents(corpus())
    got = near.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted({r[1] for r in brute(corpus())}, key=str)
    assert near.deduplicate(documents([])).count() == 0


def test_probability_jaccard():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x = {int(k): float(rng.random() + 0.1) for k in rng.choice(30, 12, replace=False)}
        y = {int(k): float(rng.choice([0.5, 1.0, 2.0])) for k in rng.choice(30, 9, replace=False)}
        got = near.probability_jaccard(*(np.array(v) for v in (sorted(x), [x[k] for k in sorted(x)], sorted(y), [y[k] for k in sorted(y)])))
        assert got == pytest.approx(similarity(x, y))


def test_registers_agree_as_often_as_texts_are_alike():
    rng = random.Random(8)
    words = [f"v{k}" for k in range(400)]
    a = [rng.choice(words) for _ in range(150)] + words[:20] * 3
    b = a[:110] + [rng.choice(words) for _ in range(40)] + words[:20] * 2
    texts = [" ".join(a), " ".join(b)]
    piece = next(flat(pa.array(texts)))
    owner = near.prob_minhash(*near.weighted(piece, 5), 2, 4000)
    true = similarity(weights(texts[0]), weights(texts[1]))
    assert 0.2 < true < 0.9
    assert (owner[0] == owner[1]).mean() == pytest.approx(true, abs=4.5 * np.sqrt(true * (1 - true) / 4000))


def test_shingles_match_words():
    texts = ["", "A b", "a B c d e", "x y z " * 30, None, "é É ß", "a-b a,b"]
    for chunk in (1, 1 << 20):
        for piece in flat(pa.array(texts), chunk):
            row, _, n = shingles(*piece.words(), piece.n)
            for i in range(piece.n):
                assert sorted(n[row == i]) == sorted(round(float(np.exp(w - 1))) for w in weights(texts[piece.first + i]).values())


def test_components(spark):
    rng = random.Random(1)
    links = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(220)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("s", f"t{i}") for i in range(50)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: find(x) for pair in links for x in pair if pair[0] != pair[1]}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_stars_are_seen_without_a_further_round(spark, monkeypatch):
    """Each table that is stored costs a job of all partitions; one round is enough for stars, chains need more."""
    from sketchframe.llm import components as module

    stored, write = [], module.write_out
    monkeypatch.setattr(module, "write_out", lambda df, label: stored.append(label) or write(df, label))
    links = [("a", f"b{i}") for i in range(30)] + [("c", "d")]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {"a": "a", "c": "c", "d": "c", **{f"b{i}": "a" for i in range(30)}}
    assert len(stored) == 5


def test_small_tables_are_not_cut_into_the_session_s_partitions(spark, documents, monkeypatch):
    """A few hundred rows over 64 shuffle partitions, with no coalescing by the session, are a few parts and not 64 files a step."""
    from sketchframe.llm import components as module

    files = []

    def counted(df, label):
        stored = write(df, label)
        files.append((label, len(stored.inputFiles())))
        return stored

    write = near.write_out
    monkeypatch.setattr(near, "write_out", counted)
    monkeypatch.setattr(module, "write_out", counted)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rows = corpus()
        got = near.near_classes(documents(rows)).select("doc_id", "class_id", "class_size", "kept").collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted(map(tuple, got), key=str) == brute(rows)
    narrow = {"nodes", "sizes", "met", "wanted", "leaders", "led", "least", "links", "placed", "mixed", "split", "named", "groups"}
    assert narrow <= {label for label, _ in files}
    assert max(n for label, n in files if label in narrow) <= LEAST_PARTS


def test_parts_grow_with_the_rows(spark):
    table = spark.range(0, 1000, 1, 64)
    assert in_parts(table, 1000).rdd.getNumPartitions() == LEAST_PARTS
    assert in_parts(table, 20 * PART_ROWS).rdd.getNumPartitions() == 20
    assert in_parts(table, 10**9).rdd.getNumPartitions() == 64
    assert in_parts(table, 1000).count() == 1000
