"""Each registered query against its SQL in DuckDB at the smallest scale."""

import glob
import math
import os
from collections import Counter

import pytest

from textloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = Counter(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in registry.oracle_sql():
        assert got
        return
    cur = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    order = [names.index(c) for c in sorted(df.columns)]
    assert sorted(names) == sorted(df.columns)
    assert got == Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
