"""Every registered query runs on the smallest tables; oracle SQL agrees where given."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from fixtures import SF_SMALL
from shroud.sources.tables import TABLES


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return norm(tuple(v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    rows = sorted((norm(tuple(r[c] for c in cols)) for r in df.collect()), key=repr)
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    res = duck.execute(sql)
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = {c: i for i, c in enumerate(ocols)}
    orows = sorted((norm(tuple(r[idx[c]] for c in cols)) for r in res.fetchall()), key=repr)
    assert rows == orows


def test_entry(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"type", "docs", "matches"}
    df.collect()
