"""Each query with SQL has the same rows as it, over the smallest tables."""

import math

import duckdb
import pytest

from topicspark.plans import queries as plans

TABLES = "documents embeddings pages benchmark labels conversations events".split()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_like_sql(spark, data, duck, name):
    df = plans.QUERIES[name](spark, data)
    want = duck.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(map(tuple, df.collect()), df.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.SQL.keys()))
def test_others_run(spark, data, name):
    assert plans.QUERIES[name](spark, data).count() > 0
