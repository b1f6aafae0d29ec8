"""Every registered query of the core against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loomgraph.plans import catalog  # noqa: F401  registers more of them
from loomgraph.plans import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def text(v):
    return repr(round(v, 5)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, DATA)
    got = sorted(tuple(text(v) for v in r) for r in df.select(*sorted(df.columns)).collect())
    if name not in Q.ORACLE_SQL:
        assert got
        return
    cur = con.execute(Q.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(tuple(text(r[i]) for i in order) for r in cur.fetchall())


def test_entry_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
