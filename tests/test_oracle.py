"""Every registered query equals its DuckDB oracle (exact, order-insensitive) at sf0.001."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import compare, duck

# the ledger queries; those of the training-data subpackage have tests of their own
QUERIES = {n: q for n, q in E.queries().items() if n in E.SCENARIOS}
SQL = {n: q for n, q in E.oracle_sql().items() if n in E.SCENARIOS}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    problems, *_ = compare(spark, con, name, QUERIES[name](spark, SF_SMALL), SQL[name])
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].operation_count > 0
