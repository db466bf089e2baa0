"""Queries over keys as large as those of 60 copies of the tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tendril import catalog


@pytest.fixture(scope="module")
def shifted(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shifted"))
    orders = spark.read.parquet(f"{data}/orders.parquet")
    orders.withColumn("o_orderkey", F.col("o_orderkey") + 8_850_000).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", ["readings_one_pass", "detail_notes"])
def test_same_as_sql(spark, shifted, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{shifted}/orders.parquet/*.parquet'")
    result = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    found = catalog.QUERIES[name](spark, shifted).select(*columns).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, result.fetchall()))
