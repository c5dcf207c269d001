import hashlib

import pytest
from pyspark.sql import functions as F

from sketchframe.llm import exact

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b " * 3000), (6, "b " * 3000), (6, "b " * 3000), (7, "c"), (None, "c"), (None, "d"), (None, "d"), (9, "e"), (9, "f")]


def expected(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        done = False
        for i in ids:
            kept = i == best and not done
            done = done or kept
            out.append((i, best, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_classes(documents, keep, weak):
    """Also where the hash is so weak that different texts share it."""
    options = {"content_hash": lambda c: F.length(c).cast("string")} if weak else {}
    got = exact.classes(documents(ROWS), keep, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS, keep)


def test_empty_table(documents):
    assert exact.classes(documents([])).count() == 0
    assert exact.deduplicate(documents([])).count() == 0


def test_deduplicate_keeps_columns_and_one_row(documents):
    docs = documents(ROWS)
    got = exact.deduplicate(docs, "largest")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted(
        [(2, "a"), (4, ""), (6, "b " * 3000), (7, "c"), (None, "d"), (9, "e"), (9, "f")], key=str
    )


def test_unknown_rule(documents):
    with pytest.raises(ValueError):
        exact.classes(documents([]), "any")
