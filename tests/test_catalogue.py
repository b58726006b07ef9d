"""Every registered query with an oracle against DuckDB on the smallest tables; the others run."""

import datetime
import os

import duckdb
import pytest

from tidegraph.plans import batch, domain, extraction, graph, ingest, mentions, normalise, questions, search  # noqa: F401
from tidegraph.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    return round(v, 5) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    r = db.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, x, strict=True))[c]) for c in cols) for x in r.fetchall()), key=repr)
    assert got == want
