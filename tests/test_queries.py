"""Every query of the main library against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tallysift.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.partition('.')[0]} as select * from '{DATA}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(ours.columns)
    theirs = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    key = lambda rows: sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in rows)
    rows = [r.asDict() for r in ours.collect()]
    assert key(rows) == key(theirs)
    assert rows or name in ("cross_side_pairs",)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)
