"""Every registered query of the dialect runs on the smallest tables and agrees with its oracle, if it has one."""

from __future__ import annotations

import os
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from tsqlspark import queries as dialect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in dialect.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (Decimal, float)):
        return round(float(v), 6)
    if isinstance(v, date) and not isinstance(v, datetime):
        return datetime(v.year, v.month, v.day)
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", list(dialect.queries()))
def test_query(spark, oracle, name):
    df = dialect.queries()[name](spark, SF)
    got = table(df.columns, df.collect())
    sql = dialect.oracle_sql().get(name)
    if sql:
        found = oracle.execute(sql)
        want = table([d[0] for d in found.description], found.fetchall())
        assert got == want
