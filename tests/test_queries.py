"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def _same(a, b) -> bool:
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(_plain(r[c]) for c in columns) for r in df.collect()], key=str)
    if name not in registry.ORACLE_SQL:
        assert len(got) == df.count()
        return
    con = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    want = sorted([tuple(_plain(r[names.index(c)]) for c in columns) for r in con.fetchall()], key=str)
    assert len(got) == len(want)
    assert [x for x in zip(got, want) if not all(map(_same, *x))] == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
