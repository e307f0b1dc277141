"""Every query that has SQL gives the rows that DuckDB gives on the same tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from sparkloom.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert Counter(tuple(plain(r[c]) for c in names) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert catalog.ORACLES.keys() <= catalog.QUERIES.keys()
