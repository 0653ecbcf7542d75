"""Every query with a DuckDB twin gives its rows; others run. Small scale; the twins of the optional subpackage are tested there."""

import os

import duckdb
import pytest

from spanforge.plans.all_queries import ORACLES, QUERIES
from spanforge.plans.registry import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return round(float(v), 6) if type(v).__name__ in ("float", "Decimal", "int") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())
    assert sorted(repr(tuple(plain(v) for v in r)) for r in rows) == want
