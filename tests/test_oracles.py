"""Every engine query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

from metrika.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "conversations", "benchmark", "labels", "pages"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[k]) for k in order)) for r in cursor.fetchall())
