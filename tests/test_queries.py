import pytest

from siftwell.plans import catalog
from tests.compare import duck_rows, spark_rows
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == duck_rows(duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
