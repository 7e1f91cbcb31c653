"""Every registered query with an oracle, Spark vs DuckDB on sf0.001 (the
driver does the same at sf0.01)."""

import pytest

import __spark_entry__ as E
from conftest import SF
from factloom.plans import catalog
from oracle_check import compare, duck

catalog.load_all()
NAMES = sorted(catalog.ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF, con)
    assert r["match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "relation" in df.columns
