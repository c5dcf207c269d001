"""Every registered query against its SQL, over whole tables."""

import pytest
from checking import connect, difference

from sketchframe.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, ROOT).toPandas()
    if name in ORACLES:
        assert difference(got, con.execute(ORACLES[name]).df()) is None
    else:
        assert len(got) > 0


def test_only_solvers_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"lr_train", "lr_predict"}
