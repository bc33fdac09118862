"""Each registered query that has SQL gives what DuckDB does, over the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__
from siltworks.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return datetime.datetime(v.year, v.month, v.day)
    return v


def table(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_as_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    rows = db.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in rows.description]
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(columns, rows.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
