"""Each query with an oracle, against DuckDB on the smallest tables."""

import math
import os

import pytest

import textloom.plans.workflow  # noqa: F401  joins its queries
from textloom.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "part events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert _same(rows(df.columns, df.collect()), rows(columns, cur.fetchall()))


def _same(x, y):
    assert len(x) == len(y)
    for a, b in zip(x, y):
        for p, q in zip(a, b):
            assert p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-4, (a, b)
    return True


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
