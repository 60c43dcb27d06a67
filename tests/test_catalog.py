"""Every query with a SQL twin gives the twin's rows; the others give rows that hold what they promise."""

import pytest
from twins import check, connect

from helicase.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_twin(spark, sf_dir, con, name):
    check(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows_only(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert catalog.FLAGSHIP(spark, sf_dir).columns == ["id", "bases", "gc", "longest_run", "error"]
