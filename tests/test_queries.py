"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from sitewise.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages"


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return f"{type(v).__name__}:{v}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    cur = duck.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, cur.fetchall())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 3
    assert "pcc_by_cpg_median" in out.columns
