"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import math
import os

import duckdb
import pytest

from threadmill.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "asDict") or isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    r = duck.execute(catalogue.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(str([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.SQL.keys()))
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() >= 0
