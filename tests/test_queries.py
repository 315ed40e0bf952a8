"""Every registered query against its SQL, run by DuckDB on the same tables."""

import decimal

import duckdb
import pytest

from millrace.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in names)) for r in got.collect())
    cur = con.execute(catalog.ORACLE[name])
    head = [x[0] for x in cur.description]
    assert sorted(head) == names
    assert rows == sorted(repr(tuple(plain(r[head.index(c)]) for c in names)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
