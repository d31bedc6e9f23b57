import pytest

from tests.oracle import DATA, mismatches
from tidelog.llm import catalog


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_queries_equal_their_sql(spark):
    assert mismatches(spark, catalog.queries(), catalog.oracle_sql()) == []


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    catalog.queries()[name](spark, str(DATA)).collect()
