"""Queries against their SQL on the smallest test tables; skipped where these aren't."""

import math
import os

import pytest

import __spark_entry__ as E

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def norm(v):
    if v is None or isinstance(v, (bool, str, int)):
        return v
    v = float(v)
    return "nan" if math.isnan(v) else round(v, 5) + 0.0


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(k for k in E.oracle_sql()))
def test_sql(spark, duck, name):
    df = E.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(E.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["extract_contacts", "extract_routed", "html_extract", "rate_limit_decisions", "cache_ttl_replay", "search_procurement", "search_insight", "expand_queries", "feed_search_stemmed", "p5_found"])
def test_runs(spark, name):
    assert E.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert E.entry(spark).count() > 0
