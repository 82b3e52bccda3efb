"""Every query with an SQL twin gives the twin's rows."""

import datetime
import os

import duckdb
import pytest

from quillstream.plans.feed import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def norm(v):
    return "~" if v is None else f"{v:.6f}" if isinstance(v, float) else v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = db.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want
