"""Every query with SQL gives the SQL's rows on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from chronoweave.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name in ORACLE:
        names = ", ".join(f'"{c}"' for c in columns)
        want = sorted((tuple(map(plain, r)) for r in duck.sql(f"SELECT {names} FROM ({ORACLE[name]})").fetchall()), key=repr)
        assert got == want
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["name", "dst", "since", "episode_id"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
