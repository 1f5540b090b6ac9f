"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from dosewell import queries
from tests.compare import assert_same, connection


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, con, sf_dir, name):
    assert_same(spark, con, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["plan", "structure", "bin", "dose", "above", "fraction"]
    assert df.count() > 0
