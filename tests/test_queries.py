"""Every registered query with SQL against DuckDB on the smallest tables; every other one must run."""

import os
from decimal import Decimal

import duckdb
import pytest

from larkspur.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (float, Decimal)):
        return round(float(v), 5)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=key)
    if name not in Q.ORACLES:
        assert df.columns
        return
    cur = duck.execute(Q.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=key)
    assert got == want
