"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from tallyspark.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in SQL:
        assert got
        return
    ran = db.execute(SQL[name])
    there = [x[0] for x in ran.description]
    assert sorted(there) == columns
    assert got == sorted(repr(tuple(plain(r[there.index(c)]) for c in columns)) for r in ran.fetchall())
