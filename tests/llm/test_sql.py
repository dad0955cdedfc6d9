import pytest

from engrama.llm.queries import QUERIES, SQL
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert_same(spark, sf, QUERIES[name], SQL[name])


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
