"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from vitalframe.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def text(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    return str([text(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    found = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in found.collect())
    sql = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in sql.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(text(dict(zip(names, r, strict=True))[c]) for c in columns) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
