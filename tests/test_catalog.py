"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from corvane.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return f"{float(v):.6f}" if isinstance(v, float) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "position", "chunk_id", "rrf"]
