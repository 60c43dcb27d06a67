"""The queries of the corpus operators against their SQL."""

import pytest
from twins import check, connect

from helicase.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, sf_dir, name):
    check(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name])
