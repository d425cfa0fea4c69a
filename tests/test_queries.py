"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from tremolite import registry
from tremolite.testbed import TABLES

# The operators for training text have tests of their own.
SQL = entry.oracle_sql()
QUERIES = {name: fn for name, fn in entry.queries().items() if name in registry.QUERIES}
# Long iterative flows; their parts are tested on small fixtures in test_inversion.py and their rows in check.py.
LONG = {"em_iteration", "append_run_log", "damped_solve"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - LONG))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in SQL:
        assert got and len(set(df.columns)) == len(df.columns)
        return
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    c1, a = check.rows(df.columns, [[check.norm(v) for v in x] for x in got])
    c2, b = check.rows(names, [[check.norm(v) for v in x] for x in want])
    assert c1 == c2
    assert sorted(map(check.exact, a)) == sorted(map(check.exact, b))


def test_flagship_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
