"""The queries over the second batch against their SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from whygraph import second_batch

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", second_batch.QUERIES)
def test_query_equals_its_sql(spark, name):
    found = second_batch.QUERIES[name](spark, TABLES)
    names = ", ".join(f'"{c}"' for c in found.columns)
    connection = duckdb.connect()
    for table in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    rows = connection.execute(f"SELECT {names} FROM ({second_batch.ORACLE_SQL[name]})").fetchall()
    assert rows and Counter(map(tuple, found.collect())) == Counter(rows)
