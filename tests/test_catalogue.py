import pytest

from compare import check
from lexiloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, small, duck, name):
    check(catalogue.QUERIES[name](spark, small), duck, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_gives_rows(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry_point_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 20
