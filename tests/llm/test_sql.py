"""Registered queries against their DuckDB texts, on the smallest tables."""

import pytest

from lorekeep.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_those_of_the_sql(name, spark, sf_dir):
    same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])
