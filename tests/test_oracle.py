import pytest

from engrama.plans import CORE_QUERIES, CORE_SQL
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert_same(spark, sf, CORE_QUERIES[name], CORE_SQL[name])


def test_every_sql_has_a_query():
    assert set(CORE_SQL) <= set(CORE_QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
