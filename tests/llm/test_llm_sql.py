"""The queries on the smallest tables against their DuckDB SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from tallysift.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.partition('.')[0]} as select * from '{DATA}/{file}'")
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    ours = QUERIES[name](spark, DATA)
    assert sorted(ours.columns) == sorted(names)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    key = lambda rows: sorted(tuple(map(plain, r)) for r in rows)
    rows = [tuple(r) for r in ours.select(names).collect()]
    assert rows and key(rows) == key(found.fetchall())
