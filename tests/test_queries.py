"""Every registered query on the smallest tables; equal to its SQL where it has one."""
import pytest

from oracles import compare, connect
from cellwire.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, FOLDER, QUERIES[name], ORACLES[name]) in (None, "both empty")
    else:
        df = QUERIES[name](spark, FOLDER)
        assert df.columns and df.count() >= 0
