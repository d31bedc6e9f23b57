import pytest

from tests.oracle import DATA, mismatches
from tidelog.plans import catalog


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_queries_equal_their_sql(spark):
    assert mismatches(spark, catalog.queries(), catalog.oracle_sql()) == []
