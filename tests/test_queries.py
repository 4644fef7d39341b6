"""Every registered query runs on the smallest tables and equals its SQL."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

from tessera.queries import QUERIES, SQL
from tessera.session import TABLES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{D}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal | int | float):
        return "nan" if v != v else round(float(v), 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        r = duck.sql(SQL[name])
        at = [r.columns.index(c) for c in cols]
        assert sorted(r.columns) == cols
        assert got == Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())
    else:
        assert got
