"""Every query with an oracle gives the rows of its SQL on DuckDB; the others run."""

import glob
import os

import duckdb
import pytest

import tessera.plans.lifecycle  # noqa: F401
from tessera.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    cur = con.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(norm(r[c]) for c in sorted(names))) for r in got)
