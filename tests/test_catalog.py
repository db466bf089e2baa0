"""Every query with SQL against DuckDB on the same tables."""

import duckdb
import pytest

from tendril import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def in_order(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(tuple(shown(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, data, name):
    df = catalog.QUERIES[name](spark, data)
    result = duck.execute(catalog.ORACLE_SQL[name])
    assert in_order([tuple(r) for r in df.collect()], df.columns) == in_order(result.fetchall(), [c[0] for c in result.description])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).limit(5).collect() is not None


def test_no_sql_without_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
