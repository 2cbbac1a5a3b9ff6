"""Every query that has SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

QUERIES, SQL, AT = __spark_entry__.queries(), __spark_entry__.oracle_sql(), "/root/testdata/sf0.001"


def cell(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(AT):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{AT}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, AT)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    expected = sorted(tuple(map(str, map(cell, r))) for r in want.fetchall())
    assert sorted(tuple(map(str, map(cell, r))) for r in got.select(*names).collect()) == expected


@pytest.mark.parametrize("name", ["rec_encode", "rec_checksum", "src_decode"])
def test_other_queries_hold(spark, name):
    rows = QUERIES[name](spark, AT).collect()
    assert len(rows) == 200
    assert all(v for r in rows for k, v in r.asDict().items() if k in ("ok", "rejected", "mended"))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["rank", "doc_id", "score"]
