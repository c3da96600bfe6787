"""The queries that SQL can express have its rows, over the smallest tables."""

import duckdb
import pytest

from topicspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_like_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, data).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
