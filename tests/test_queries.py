"""Every registered query against its SQL on the smallest tables; those without SQL must run and give rows."""

import pytest
from rows_equal import same_rows

from stratacloud.catalog import FLAGSHIP, ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, small, name):
    same_rows(QUERIES[name](spark, small).toPandas(), duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.queries()[FLAGSHIP](spark, small).count() > 0
    assert __spark_entry__.entry(spark).columns == ["point_id", "node_key", "lon", "lat", "height", "rgb"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
