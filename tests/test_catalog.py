"""Every query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from weftgraph import catalog


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf, duck):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(set(df.columns)) == len(df.columns)
        return
    res = duck.execute(sql)
    own = [d[0] for d in res.description]
    at = [own.index(c) for c in sorted(own)]
    assert sorted(own) == cols
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in res.fetchall()), key=repr)
