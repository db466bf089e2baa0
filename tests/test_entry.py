import __spark_entry__


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).columns == ["o_orderkey", "o_custkey", "state", "days_left", "n_docs", "n_done"]
