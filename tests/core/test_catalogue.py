"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from tests.core.oracle import connect, rows
from veilframe.plans import catalogue, identities, reporting  # noqa: F401


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_duckdb(spark, sf_dir, con, name):
    got = rows(catalogue.QUERIES[name](spark, sf_dir).toPandas())
    want = rows(con.execute(catalogue.SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_queries_without_sql_run(spark, sf_dir):
    for name in set(catalogue.QUERIES) - set(catalogue.SQL):
        assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
