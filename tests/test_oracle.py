import pytest

from tests.oracle import assert_same, connect


def names():
    from quillspark.plans import catalogue

    return sorted(catalogue.ORACLE)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, sf, con, name):
    from quillspark.plans import catalogue

    assert_same(catalogue.QUERIES[name](spark, sf), con, catalogue.ORACLE[name])


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 12
    assert set(e.oracle_sql()) <= set(e.queries())
