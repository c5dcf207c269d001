"""Fixtures of the corpus operators; the session comes from the tests above."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names operators use inside."""

    def build(rows):
        data = [(i, t, "en", "src" + str((i or 0) % 3), len(t or "")) for i, t in rows]
        plain = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        return plain.selectExpr("*", "'x' as key", "1 as rows", "'y' as h", "2 as n", "3 as id", "'z' as line", "4 as row", "5 as label", "6 as _key", "'w' as print", "7 as kept")

    return build
