"""Every query with an oracle against DuckDB on the smallest driver tables."""

import math
import os

import __spark_entry__
import duckdb
import pytest
from sluice.plans import suite

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9))
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(suite.ORACLE_SQL))
def test_query_equals_oracle(name, spark, duck):
    df = suite.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(suite.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(suite.QUERIES) - set(suite.ORACLE_SQL)))
def test_query_without_oracle_gives_rows(name, spark):
    assert suite.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
