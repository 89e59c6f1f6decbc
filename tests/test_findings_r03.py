"""Queries on tables larger than the shipped ones."""

import duckdb
import pytest
from pyspark.sql import functions as F
from rows_equal import same_rows

from stratacloud.catalog import ORACLE_SQL, QUERIES
from stratacloud.functions.requests import response_error


def orders_of(spark, small, tmp_path, keys):
    """Orders outside the root, and two of them under every key."""
    o = spark.read.parquet(f"{small}/orders.parquet")
    more = o.orderBy("o_orderkey").limit(2).drop("o_orderkey").crossJoin(keys)
    o.filter("o_orderkey % 512 <> 0").unionByName(more.select(o.columns)).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def equals_sql(spark, d, name, table):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet/*.parquet'")
    same_rows(QUERIES[name](spark, d).toPandas(), c.sql(ORACLE_SQL[name]).df())


def test_sink_gets_the_whole_node(spark, small, tmp_path):
    d = orders_of(spark, small, tmp_path, spark.range(1, 3_001).select((F.col("id") * 512).alias("o_orderkey")))
    equals_sql(spark, d, "udf_2_user_sink", "orders")
    assert QUERIES["udf_2_user_sink"](spark, d).first()["rows"] == 6_000


@pytest.mark.parametrize("name", ["src_4_response_check", "src_5_retries", "src_7_error_counts"])
def test_requests_beyond_the_total_of_the_log(spark, small, tmp_path, name):
    e = spark.read.parquet(f"{small}/events.parquet")
    # Requests on both sides of byte 999,999,999, the total in all headers.
    e.withColumn("event_id", F.col("event_id") + 999_950).write.parquet(f"{tmp_path}/events.parquet")
    equals_sql(spark, str(tmp_path), name, "events")


def test_total_below_the_end_of_a_range_is_an_error(spark):
    rows = [(0, "bytes 0-9/9"), (1, "bytes 0-9/10"), (2, "bytes 0-9/*"), (3, "bytes 0-8/99")]
    a = spark.createDataFrame(rows, "id int, header string")
    of = lambda **o: response_error(F.lit(206), F.col("header"), F.lit(10), F.lit(0), F.lit(10), **o)
    found = a.select("id", of().alias("checked"), of(check_total=False).alias("unchecked")).orderBy("id").collect()
    assert [r["checked"] for r in found] == ["content-range", None, None, "content-range"]
    assert [r["unchecked"] for r in found] == [None, None, None, "content-range"]


def test_pages_are_found_per_node_not_per_point(spark, small, tmp_path):
    # A copy, as other tests keep the catalog of the original.
    spark.read.parquet(f"{small}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    lines = QUERIES["src_17_expand_page"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [len(text) - len(text.lstrip(" :+-")) for text in lines]
    catalogs = [i for i, text in enumerate(lines) if "Aggregate [" in text and "count(" not in text and "nx#" in text]
    assert len(catalogs) == 3
    for i in catalogs:
        below = next((j for j in range(i + 1, len(lines)) if at[j] <= at[i]), len(lines))
        assert not any("sequence(" in text or "Filter" in text for text in lines[i + 1 : below])
