import pytest

from lectern.plans import catalogue
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, sf, name):
    assert name in catalogue.SQL
    same(catalogue.QUERIES[name](spark, sf), catalogue.SQL[name], sf)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
