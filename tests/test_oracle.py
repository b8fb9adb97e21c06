"""Every registered query with an oracle equals DuckDB on the smallest scale."""

import pytest

import __spark_entry__ as E

from helpers import duck, same

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_registry_contract():
    qs = E.queries()
    assert set(SQL) <= set(qs)
    assert len(qs) >= 30


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_records"] == 1000


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf_dir, con, name):
    same(E.queries()[name](spark, sf_dir), con, SQL[name])
