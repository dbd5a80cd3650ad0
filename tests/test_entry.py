"""Every terrain query against its SQL on the smallest tables, and the driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from cairn.plans import queries as terrain

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v) + 0.0:.7g}"
    return str(v)


def rows(found, names):
    return sorted(tuple(plain(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(terrain.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = terrain.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = df.select(*names).collect()
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({terrain.ORACLES[name]})")
    assert sorted(want.columns) == names
    assert rows(got, names) == rows(want.fetchall(), names)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(terrain.QUERIES) <= set(entry.queries())
