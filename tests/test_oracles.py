"""Every query of the engine against its DuckDB SQL, on the smallest tables."""

import math
import os

import pytest

from strataseek import queries as Q


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck(tiny):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(tiny):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{tiny}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, tiny, name):
    df = Q.QUERIES[name](spark, tiny)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    r = duck.execute(Q.SQL[name])
    at = {x[0]: i for i, x in enumerate(r.description)}
    assert sorted(at) == names
    want = sorted((tuple(plain(row[at[n]]) for n in names) for row in r.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_without_sql_gives_rows(spark, tiny, name):
    assert Q.QUERIES[name](spark, tiny).count() > 0
