import pytest

from compare import SF, difference
from foretally.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, catalogue.QUERIES[name], catalogue.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
