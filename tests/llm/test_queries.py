"""Every query with SQL against that SQL, over odd rows; every query over empty tables."""

import pytest

from vecloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, compare, folder, name):
    compare(queries()[name](spark, folder), oracle_sql()[name], folder)


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0
