import pytest
from oracle import same

from spreadgraph.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    if name in SQL:
        same(df, SQL[name], sf)
    else:
        assert len(df.collect()) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["rank", "user_id", "k_out"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
