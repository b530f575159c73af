import pytest

from corviq import dialect_queries, queries, store_queries  # noqa: F401
from tests.conftest import DATA, same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    same(duck, queries.SQL[name], queries.QUERIES[name](spark, DATA))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
