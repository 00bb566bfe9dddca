"""Every registered query against its SQL counterpart on the small tables."""

import os

import pytest

import __spark_entry__ as contract
from tests.parity import compare, connect

FOLDER = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        _, problems = compare(spark, con, name, QUERIES[name], ORACLES[name], FOLDER)
        assert not problems
    else:
        assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
