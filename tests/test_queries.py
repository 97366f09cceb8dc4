"""Registered queries against their SQL on the smallest given tables."""

from pathlib import Path

import pytest

from keelson.plans.oracles import ORACLES
from keelson.plans.queries import QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    state, rows, detail = compare(spark, db, SF, name)
    assert state == "ok", (rows, detail)
